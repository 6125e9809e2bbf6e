"""Quality rules: counted base rules, then a log-likelihood ratio of hashed n-grams, trusted target against raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, byte_ngrams, sieve, small_batches

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

ORDERS = (1, 2, 3)
BITS = 16
# partial counts travel in so many arrays a partition, and are first added up in so many tasks
SLICES, FIRST_SUMS = 16, 64
# mean log ratio per n-gram under which a text is dropped: far from the trusted texts, which lie around zero
MARGIN = -0.3


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; a null text counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()  # bytes split on exactly the ASCII white space
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeats = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        size = len(ids)
        # windows are numbered in two steps, so that the numbers stay under the square of the text's length
        pairs = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1].astype(np.int64)
        _, where, times = np.unique(pairs[:-1] * size + w[2:], return_inverse=True, return_counts=True)
        again = times[where] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def buckets(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.concatenate([byte_ngrams(data, n, BITS) for n in ORDERS])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all hashed n-grams of every ``text``, 2**BITS numbers whatever the input's size.

    Each partition adds up its own and hands on SLICES rows, each an array of the counts of neighbouring buckets. Tasks
    add up arrays as they stream in: first spread evenly, then by slice, so that no task gets a row of every partition.
    """
    width = (1 << BITS) // SLICES
    schema = "slice int, counts array<long>"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BITS, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    total += np.bincount(buckets(t), minlength=1 << BITS) if len(t) > 20000 else 0
                    if len(t) <= 20000:
                        np.add.at(total, buckets(t), 1)
        if total.any():
            yield pd.DataFrame({"slice": range(SLICES), "counts": list(total.reshape(SLICES, width))})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, part in zip(pdf["slice"], pdf["counts"]):
                sums[k] = sums[k] + part if k in sums else np.array(part, np.int64)
        if sums:
            yield pd.DataFrame({"slice": list(sums), "counts": list(sums.values())})

    # arrays of 32 KB: few to an Arrow batch
    with small_batches(texts.sparkSession, 256):
        own = texts.select("text").mapInPandas(count, schema)
        rows = own.repartition(FIRST_SUMS).mapInPandas(add, schema).repartition(SLICES, "slice").mapInPandas(add, schema).collect()
    out = np.zeros((SLICES, width), np.int64)
    for r in rows:
        out[r["slice"]] += np.array(r["counts"], np.int64)
    return out.ravel()


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two smoothed multinomials for each bucket; zero everywhere when either corpus is empty."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw), np.float64)
    p, q = target + 1.0, raw + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Bucket log ratios from every text of ``docs`` (raw corpus) and every text of ``trusted`` (target)."""
    return ratios(bucket_counts(trusted), bucket_counts(docs))


def score(table: np.ndarray, text: str | None) -> float:
    """Mean log ratio over all n-grams of the whole text; 0 for a text without any."""
    ids = buckets(text) if text else []
    return float(table[ids].mean()) if len(ids) else 0.0


def judge(docs: DataFrame, table: np.ndarray, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, llr and kept.

    ``kept`` is false when the base rules fail, else whether the mean log ratio reaches ``margin``: a fixed threshold,
    so every document is decided alike at every run. Null and empty texts have no words and fail the base rules; a null
    doc_id stays null; repeated rows are judged alike; other columns of ``docs`` aren't read; no rows give no rows.
    """

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")
    def rules(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            counts, llr = base_counts(t), score(table, t)
            failed = base_failed(counts[0], counts[4])
            out.append((*counts, failed, llr, not failed and llr >= margin))
        return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    return docs.select("doc_id", rules("text").alias("r")).select("doc_id", "r.*")


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of all documents labelled good: the target corpus."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    near = sieve(docs.select("doc_id", "text"), F.col("doc_id"), good, F.col("doc_id"))
    # both sides grow with the input, so the join is a merge at every size
    return near.join(good.hint("merge"), "doc_id", "left_semi").select("text")
