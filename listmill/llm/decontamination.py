"""Benchmark decontamination: an FM-index over every shard of documents, searched backwards for the windows of test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

WINDOW = 10
# words of a shard, of a block of benchmark windows, and of a piece that an item is cut into
SHARD_WORDS, BLOCK_WORDS, PIECE_WORDS = 1_000_000, 100_000, 1_000
# every so many words a suffix position is kept
SAMPLE = 16

# Fixed values of the contract: A-Z become a-z; ASCII other than digits and letters parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", T.ArrayType(SPAN)), ("items", T.ArrayType(T.LongType())))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. Every 0 is an end of its own, lower than any symbol, earlier ends lower.

    Prefix doubling: ranks by the first h symbols give ranks by 2h. Only suffixes that still share their rank are sorted
    again, so that long repeats cost a sort of their own words for each doubling and the rest nothing.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    key = symbols.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.append(True, np.diff(key[order]) != 0)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    # places in order whose rank is shared
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        group = rank[at]
        # a suffix that shares its first h symbols with another has no end among them, so at + h is inside the text
        nxt = rank[at + h]
        by = np.lexsort((nxt, group))
        at, group, nxt = at[by], group[by], nxt[by]
        order[tied] = at
        new = np.append(True, (np.diff(group) != 0) | (np.diff(nxt) != 0))
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletRanks:
    """How often a symbol occurs before a place of a sequence, by a wavelet tree stored level by level."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            one = bit.astype(bool)
            sequence = np.concatenate([sequence[~one], sequence[one]])
        self.first = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            before = ones[places]
            places = np.where((symbols >> (self.bits - 1 - level)) & 1, zeros + before, places - before)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self._descend(symbols, places) - self.first[symbols]


class FMIndex:
    """Counts and locates phrases in a sequence of symbols (1 and up; every 0 ends a stretch) without scanning it."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        # the word before the first place is the last one, which is an end
        self.last_column = before
        self.ranks = WaveletRanks(before, n_symbols)
        self.starts = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=n_symbols), out=self.starts[1:])
        # every sample-th place is kept, and every first place of a stretch, beyond which no walk can go
        kept = (order % sample == 0) | (before == 0)
        self.kept_rows = np.zeros(len(order) + 1, np.int32)
        np.cumsum(kept, out=self.kept_rows[1:])
        self.kept_places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row (exclusive) of every phrase, all of one length, words of unknown symbols excluded."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last_column), np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.starts[c] + self.ranks.rank(c, low[alive])
            high[alive] = self.starts[c] + self.ranks.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place of the suffix of every row: steps to the word before until a kept place is met."""
        places, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            r = rows[open_]
            kept = self.kept_rows[r + 1] > self.kept_rows[r]
            done = open_[kept]
            places[done] = self.kept_places[self.kept_rows[r[kept]]] + steps[done]
            open_ = open_[~kept]
            r = rows[open_]
            c = self.last_column[r]
            rows[open_] = self.starts[c] + self.ranks.rank(c, r)
            steps[open_] += 1
        return places


class Phrases:
    """The windows of a block of benchmark pieces: (item, words of a window or of several that overlap)."""

    def __init__(self, pieces: list[tuple[int | None, list[bytes]]], window: int):
        self.symbols: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, words in pieces:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1):
                by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
        # per length: the phrases, and the items of each
        self.groups = [(m, np.array(list(of), np.int64), list(of.values())) for m, of in sorted(by_length.items()) if m]
        self.shortest = self.groups[0][0] if self.groups else 0


def _stretches(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of known words that could hold a phrase, each followed by a 0, and the place each word comes from."""
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(np.diff(known))
    first, end = edges[::2], edges[1::2]
    long_ = end - first >= shortest
    first, end = first[long_], end[long_]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = end - first + 1
    places = np.repeat(first - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    symbols = np.zeros(len(places), np.int64)
    inside = places < np.repeat(end, sizes)
    symbols[inside] = ids[places[inside]]
    return symbols, places


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple]:
    """(n_words, merged spans of hit words, items) of every text, by one index over all of them."""
    get = phrases.symbols.get
    lists = [[get(w, 0) for w in words_of(t)] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    # a 0 after every text keeps phrases from running over its end
    base = np.append(0, np.cumsum(sizes + 1))
    ids = np.zeros(base[-1], np.int64)
    for at, x in zip(base, lists):
        ids[at : at + len(x)] = x
    del lists
    symbols, places = _stretches(ids, phrases.shortest) if phrases.groups else (ids[:0], ids[:0])
    edge = np.zeros(len(ids) + 1, np.int32)
    items: dict[int, set] = {}
    if len(symbols):
        index = FMIndex(symbols, len(phrases.symbols) + 1)
        for m, group, owners in phrases.groups:
            low, high = index.search(group)
            counts = high - low
            hit = np.flatnonzero(counts)
            if not len(hit):
                continue
            counts = counts[hit]
            of = np.repeat(hit, counts)
            rows = np.repeat(low[hit] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
            at = places[index.locate(rows)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m, -1)
            doc = np.searchsorted(base, at, "right") - 1
            for d, p in np.unique(np.stack([doc, of], 1), axis=0).tolist():
                items.setdefault(d, set()).update(owners[p])
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    first, end = turns[::2], turns[1::2]
    owner = np.searchsorted(base, first, "right") - 1
    out = [(int(n), [], []) for n in sizes]
    hit, at = np.unique(owner, return_index=True)
    for d, a, b in zip(hit.tolist(), at, np.append(at[1:], len(owner))):
        spans = [{"start": int(x), "end": int(y)} for x, y in zip(first[a:b] - base[d], end[a:b] - base[d])]
        out[d] = (int(sizes[d]), spans, sorted(i for i in items[d] if i is not None))
    return out


def _shards(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple]:
    """(ids, texts, spans, items) of rows with about ``limit`` words at most, or of one row that has more."""
    rows, size = [], 0
    for batch in batches:
        for i, *row in zip(batch["doc_id"], batch["text"], batch["spans"], batch["items"]):
            # about six characters a word
            n = len(row[0] or "") // 6
            if rows and size + n > limit:
                yield tuple(map(list, zip(*rows)))
                rows, size = [], 0
            rows.append((None if pd.isna(i) else int(i), *row))
            size += n
    if rows:
        yield tuple(map(list, zip(*rows)))


def cut(text: str | None, spans: list[dict]) -> str | None:
    """The text without the words of ``spans``; a removed stretch takes the characters between its words along."""
    if not spans:
        return text
    data = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(data)]
    kept, last = [], 0
    for s in spans:
        kept.append(data[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*kept, data[last:]]).decode("utf-8", "replace")


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


_PASSED = (("text", T.StringType()), ("spans", T.ArrayType(SPAN)), ("items", T.ArrayType(T.LongType())))


def _one_pass(rows: DataFrame, phrases: Phrases, shard_words: int, last: bool, with_text: bool) -> DataFrame:
    """Rows (doc_id, text, spans, items) with the hits of one block added; the last pass gives the answer's columns."""
    fields = [*FOUND, *([("cleaned", T.StringType())] if with_text else [])] if last else _PASSED
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts, spans, items in _shards(batches, shard_words):
            out = []
            for text, old, known, (n, new, more) in zip(texts, spans, items, search_shard(texts, phrases)):
                # an earlier block's answer, where there is one
                if old is not None and len(old):
                    new = merged([*new, *({"start": int(s["start"]), "end": int(s["end"])} for s in old)])
                if known is not None and len(known):
                    more = sorted({*more, *map(int, known)})
                if last:
                    hit = sum(s["end"] - s["start"] for s in new)
                    out.append((n, hit, new, more, cut(text, new)) if with_text else (n, hit, new, more))
                else:
                    out.append((text, new, more))
            found = pd.DataFrame(out, columns=[n for n, _ in fields])
            found.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            yield found

    return rows.mapInPandas(search, schema)


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words) with at most PIECE_WORDS windows a row, each window of an item in exactly one row."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(text, F.lit(f"({_WORD_SQL})"), F.lit(1))
    # written first: the pattern must not run once a piece
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("words")).where(F.size("words") > 0))
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS))).alias("s"))
    return starts.select("item_id", F.slice("words", F.col("s") + 1, PIECE_WORDS + window - 1).alias("words"))


def search(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, with_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word numbers, end exclusive, merged) and items (sorted ids) of every document.

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one. Each task cuts its documents into
    shards of about ``shard_words`` words, indexes a shard (stretches without any benchmark word, or too short for a
    phrase, can't hold one and are left out), searches all phrases backwards and locates every occurrence. Nothing of
    the documents is shuffled. The benchmark goes to the tasks in blocks of at most ``block_words`` words (and one piece
    of an item), each a pass over the documents that adds to the answer of the passes before; a usual benchmark is one.
    ``with_text`` adds ``cleaned``, the text without its hit spans.

    Null, empty and wordless texts have no words and no hits; items without words have no phrases. Rows that repeat, and
    null doc_ids, are judged row by row. An item whose id is null marks words but isn't listed; rows that share an item_id
    count as one item. Other columns aren't read. Empty tables give no rows, or no hits.
    """
    rows = docs.select("doc_id", "text", F.lit(None).cast(_PASSED[1][1]).alias("spans"), F.lit(None).cast(_PASSED[2][1]).alias("items"))
    block, size = [], 0
    for r in _pieces(benchmark, window).toLocalIterator():
        if block and size + len(r.words) > block_words:
            # written before the next block is read, so the driver and the tasks hold one block at a time
            rows = stored(_one_pass(rows, Phrases(block, window), shard_words, False, with_text))
            block, size = [], 0
        block.append((r.item_id, [w.encode("utf-8", "replace") for w in r.words]))
        size += len(r.words)
    return _one_pass(rows, Phrases(block, window), shard_words, True, with_text)
