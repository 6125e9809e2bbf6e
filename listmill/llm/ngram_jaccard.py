"""N-gram Jaccard join, size-aware: small sets enumerate subsets, large ones scan inverted lists of rare shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, aside, mix64, numbered, sieve, small_batches, stored, word_hashes
from .linkage import groups

# Fixed values of the contract: five-word shingles, and 100 * intersection >= 75 * union.
SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4

SKETCH_BITS = 18
SKETCH_BITS_MOST = 24
LARGEST_LIGHT = 12
PARITY = 8


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A-Z lower-cased.

    A text of one to four words has one shingle, the whole sequence; a null text or one without words has none.
    """
    h = word_hashes(np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8))[0]
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix64(out ^ h[k : len(h) - width + 1 + k])
    return np.unique(out)


def needed(n: int, m: int) -> int:
    """Least intersection with which sets of sizes n and m link."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def may_sizes(n: int) -> range:
    return range(-(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR + 1)


def prefix_length(n: int) -> int:
    """So many first shingles of a fixed order: sets that link have one of them in common."""
    return n - (-(-NUMERATOR * n // DENOMINATOR)) + 1


def subset_sizes(n: int) -> tuple[int, ...]:
    return tuple(sorted({needed(n, m) for m in may_sizes(n)}))


def subset_tokens(s: np.ndarray) -> np.ndarray:
    """Hashes of all subsets of the sizes that some link of this set needs; sets that link share one of them."""
    out = []
    for size in subset_sizes(len(s)):
        picks = np.array(list(combinations(range(len(s)), size)), np.int64)
        h = np.full(len(picks), np.uint64(0xA5A5A5A5 + size))
        for k in range(size):
            h = mix64(h ^ s[picks[:, k]])
        out.append(h)
    return np.concatenate(out)


def boundary(sizes: dict[int, int], meets: float) -> int:
    """Largest set size treated as small: the one of least cost over the sizes counted.

    A small set costs one posting for each subset; a large one costs its prefix, each posting times one plus the number
    of sets that a posting meets on average. Sets between 3/4 of the boundary and the boundary cost both.
    """
    subsets = lambda n: sum(math.comb(n, k) for k in subset_sizes(n))
    lists = lambda n: prefix_length(n) * (1 + meets)

    def cost(x: int) -> float:
        return sum(c * ((subsets(n) if n <= x else 0) + (lists(n) if DENOMINATOR * n > NUMERATOR * x else 0)) for n, c in sizes.items() if 0 < n <= LARGEST_LIGHT)

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def tokens(s: np.ndarray, sketch: np.ndarray, light: int) -> np.ndarray:
    """The lists that a set is in: those of its subsets if small, of its prefix if large, of both near the boundary."""
    n, out = len(s), []
    if 0 < n <= light:
        out.append(subset_tokens(s))
    if DENOMINATOR * n > NUMERATOR * light:
        shift = np.uint64(64 - int(math.log2(len(sketch))))
        out.append(s[np.lexsort((s, sketch[s >> shift]))[: prefix_length(n)]])
    return np.concatenate(out) if out else s


def count_shingles(docs: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, dict[int, int]]:
    """How often shingles fall into each of 2**bits slots of their hash, over all documents, and how many sets have
    each small size. Partitions add up their own; the result has a fixed size and orders shingles from rare to frequent.

    The order decides how long lists get, not which links are found. More bits tell more shingles apart.
    """
    width = 1 << min(bits, SKETCH_BITS_MOST)
    shift = np.uint64(64 - int(math.log2(width)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, sizes, seen = np.zeros(width, np.int64), np.zeros(LARGEST_LIGHT + 1, np.int64), set()
        for pdf in batches:
            for t in pdf["text"]:
                s = shingles(t)
                # copies within a partition say nothing about how many different sets share a shingle
                if len(s) and (key := set_hash(s)) not in seen:
                    seen.add(key)
                    slots += np.bincount((s >> shift).astype(np.int64), minlength=width) if len(s) > width // 8 else 0
                    if len(s) <= width // 8:
                        np.add.at(slots, (s >> shift).astype(np.int64), 1)
                    if len(s) <= LARGEST_LIGHT:
                        sizes[len(s)] += 1
        full, small = np.flatnonzero(slots), np.flatnonzero(sizes)
        yield pd.DataFrame({"slot": np.concatenate([full, -small]), "n": np.concatenate([slots[full], sizes[small]])})

    got = docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    slot, n = got["slot"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    sketch = np.zeros(width, np.int64)
    sketch[slot[slot >= 0]] = n[slot >= 0]
    return sketch, {int(-k): int(v) for k, v in zip(slot, n) if k < 0}


def set_hash(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number: the identity of a class of documents with equal sets."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([np.add.reduce(mix64(s ^ np.uint64(0x5BF03635))) ^ np.uint64(len(s))], np.uint64))
    return int(h.view(np.int64)[0])


def parity(s: np.ndarray) -> list[int]:
    """512 bits, each the parity of the number of shingles that fall on it. Two sets differ in at least as many
    shingles as these differ in bits."""
    odd = np.bincount((mix64(s) >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


_NODE = "n_shingles long, node long, tokens array<long>, " + ", ".join(f"p{k} long" for k in range(PARITY))


def describe(docs: DataFrame, sketch: np.ndarray, light: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, tokens, p0..p7): node identifies the set, null if empty; tokens are null where the
    partition has given those of the same set before."""
    columns = ["doc_id", "text_hash", "n_shingles", "node", "tokens"] + [f"p{k}" for k in range(PARITY)]
    broadcast = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            rows = []
            for doc_id, text_hash, t in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"]):
                s = shingles(t)
                if not len(s):
                    rows.append((doc_id, text_hash, 0, None, None, *[None] * PARITY))
                    continue
                node = set_hash(s)
                own = None if node in seen else tokens(s, broadcast.value, light).view(np.int64)
                seen.add(node)
                rows.append((doc_id, text_hash, len(s), node, own, *parity(s)))
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    # ids travel as text, because pandas has no null integer of its own
    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInPandas(run, f"doc_id string, text_hash long, {_NODE}").withColumn("doc_id", F.col("doc_id").cast("long"))


def component_ids(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id; and text_hash, node and group (the smallest node).

    Two documents link when their shingle sets have Jaccard similarity 3/4 or more; component_id is the smallest doc_id
    that links reach, the document's own included. Documents with equal sets are one class and stand together; other
    classes are joined exactly (see ``linkage``), so no link between different sets is lost. Null texts and texts
    without words have no shingles and their own doc_id. A null doc_id takes part and takes the smallest id of its
    group, null if all are null. Repeated rows give repeated rows; other columns aren't read; no rows give no rows.

    Sets are known by 64-bit hashes: the odds of a wrong link are those of two hashes colliding.
    """
    # all Python runs in jobs that end here
    with small_batches(docs.sparkSession):
        return _component_ids(docs.select("doc_id", "text"), bits)


def _component_ids(base: DataFrame, bits: int) -> DataFrame:
    sketch, sizes = count_shingles(base, bits)
    total = float(sketch.sum())
    meets = max(0.0, (float((sketch.astype(float) ** 2).sum()) - total**2 / len(sketch)) / total - 1) if total else 0.0
    light = boundary(sizes, meets)
    rows = stored(describe(base, sketch, light))
    found = rows.where(F.col("node").isNotNull())
    nodes = stored(
        found.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), *[F.first(f"p{k}").alias(f"p{k}") for k in range(PARITY)])
    )
    postings = found.where(F.col("tokens").isNotNull()).select("node", F.col("n_shingles").alias("n"), F.explode("tokens").alias("token"))

    def sizes_fit(x, y):
        return NUMERATOR * F.greatest(x("n"), y("n")) <= DENOMINATOR * F.least(x("n"), y("n"))

    def may_link(x, y):
        n, m = x("n"), y("n")
        differ = sum((F.bit_count(x(f"p{k}").bitwiseXOR(y(f"p{k}"))) for k in range(1, PARITY)), F.bit_count(x("p0").bitwiseXOR(y("p0"))))
        # |A - B| + |B - A| <= (|A| + |B|) (1 - t) / (1 + t)
        return sizes_fit(x, y) & ((NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * (n + m))

    def lists(x, y):
        """Common shingles outside of both prefixes are at most those after the prefix of the end whose prefix stops
        first; all others are lists that both are in."""
        after = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR) - 1
        both = F.ceil((x("n") + y("n")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
        large = F.greatest(F.lit(1), both - F.greatest(after(x("n")), after(y("n"))))
        return F.when((x("n") <= light) & (y("n") <= light), F.lit(1)).otherwise(large).cast("long")

    def verifier(pairs: DataFrame):
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = sets_of(ends, nodes, base)

        def verify(some: DataFrame) -> DataFrame:
            with_b = some.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
            pivots = sets.join(some.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
            with_a = with_b.join(pivots.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
            both = F.size(F.array_intersect("ga", "gb"))
            return with_a.where(DENOMINATOR * both >= NUMERATOR * (F.size("ga") + F.size("gb") - both)).select("a", "b")

        return verify

    labels = groups(postings, nodes.drop("least_id"), may_link, verifier, sizes_fit, lists)
    classes = nodes.select("node", "least_id").join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("group"))
    least = classes.groupBy("group").agg(F.min("least_id").alias("component_id"))
    named = stored(classes.join(least, "group").select("node", "group", "component_id"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    return out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, grams) of the wanted nodes, from the text of one document of each."""

    @F.pandas_udf("struct<node:long,grams:array<long>>")
    def again(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"node": [set_hash(s) for s in sets], "grams": [s.view(np.int64) for s in sets]})

    ids = stored(nodes.join(wanted, "node", "left_semi").select(F.col("node").alias("wanted"), F.col("least_id").alias("id")))
    texts = sieve(docs, F.col("doc_id"), ids, F.col("id")).join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("wanted", "text")
    return stored(texts.select("wanted", again("text").alias("s")).where(F.col("s.node") == F.col("wanted")).select(F.col("wanted").alias("node"), "s.grams"))


def keep_one(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id; all columns stay.

    Where several rows of a group have that id, the smallest text hash decides; of equal rows one stays. Rows without
    shingles belong to no group and all stay.
    """
    found = component_ids(docs, bits).where(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = found.groupBy("group").agg(F.first("doc_id").alias("__id"), F.min("text_hash").alias("__of")).select("__id", "__of")
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of"))
    rows, back = aside(docs, "doc_id", "text")
    one = numbered(rows.where(has_word)).where(F.col("__copy") == 1).join(stays, match, "left_semi")
    return back(one).unionByName(docs.where(~has_word))
