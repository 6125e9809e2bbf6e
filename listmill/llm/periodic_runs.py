"""Periodic runs of words: squares caught online over completed power-of-two blocks, merged into runs, and collapsed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = (("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed", T.StringType()))


class SquareCatcher:
    """Takes words one by one and knows every run of the text so far.

    Level k cuts the text into blocks of 2**k words. Once a block is complete its catchers wait for the block's words to
    recur at a distance p from 2**(k+1) - 1 to 2**(k+2) - 2: the first half of any square of period p holds such a
    block whole, so no square is missed, and at any time two blocks a level are waited for. Blocks are named exactly,
    by the pair of names of their halves; the words appended last have a name at level k only if both halves have one,
    so that most words settle at the first levels. A catcher that fires compares backwards (less than two blocks, else
    an earlier block had fired) and from then on every appended word carries the comparison at distance p one step
    further, until a word differs. As soon as 2p words agree a square is there; the squares of one stretch are one run.
    """

    def __init__(self):
        self.words: list = []
        # per level from the first up: names of the windows that end at a place, and names of completed blocks
        self.names: list[dict[int, int]] = []
        self.blocks: list[dict[tuple, int]] = []
        self.open: dict[int, int] = {}
        self.found: dict[tuple[int, int], int] = {}

    def append(self, word) -> None:
        self.extend((word,))

    def extend(self, more: Iterable) -> None:
        """Append words one after the other."""
        words, open_, levels, all_blocks = self.words, self.open, self.names, self.blocks
        for e, word in enumerate(more, len(words)):
            words.append(word)
            if open_:
                for p in [p for p in open_ if words[e - p] != word]:
                    self._close(p, e)
            if not e:
                continue
            before = words[e - 1]
            if before == word and 1 not in open_:
                open_[1] = e - 1
            if e > 1 and words[e - 2] == word and 2 not in open_:
                self._fire(2, 1, e)
            first, name, size, level = before, word, 2, 0
            while True:
                if level == len(levels):
                    levels.append({})
                    all_blocks.append({})
                blocks = all_blocks[level]
                if (e + 1) & (size - 1):
                    name = blocks.get((first, name))
                    if name is None:
                        break
                else:
                    name = blocks.setdefault((first, name), len(blocks))
                names = levels[level]
                names[e] = name
                # the two completed blocks that lie far enough back for this level
                j = (e - 2 * size + 2) // size * size - 1
                if j > 0 and names.get(j) == name and e - j not in open_:
                    self._fire(e - j, size, e)
                j -= size
                if j > 0 and names.get(j) == name and e - j not in open_:
                    self._fire(e - j, size, e)
                first = names.get(e - size)
                if first is None:
                    break
                size, level = size << 1, level + 1

    def _fire(self, p: int, size: int, e: int) -> None:
        """``size`` words up to place e equal those p before. A stretch inside a run whose period divides p brings no new run."""
        words = self.words
        for q, s in self.open.items():
            if p % q == 0 and e - s + 1 >= p:
                return
        x = e - size
        while x >= p and words[x] == words[x - p]:
            x -= 1
        self.open[p] = x + 1 - p

    def _close(self, p: int, e: int) -> None:
        s = self.open.pop(p)
        if e - s >= 2 * p:
            key = (s, e)
            # the same stretch under a multiple of its period is the same run
            if self.found.get(key, p) >= p:
                self.found[key] = p

    def squares(self) -> list[tuple[int, int]]:
        """(start, period) of the squares that end with the word appended last, primitive or inside a run still open."""
        e = len(self.words)
        return sorted((e - 2 * p, p) for p, s in self.open.items() if e - s >= 2 * p)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of the text so far, by start and period."""
        e, known = len(self.words), dict(self.found)
        for p in sorted(self.open, reverse=True):
            if e - self.open[p] >= 2 * p:
                known[self.open[p], e] = p
        return sorted((s, end - s, p) for (s, end), p in known.items())


def runs_of(words: list, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` words and ``min_exponent`` (2 or more) periods."""
    catcher = SquareCatcher()
    catcher.extend(words)
    return [r for r in catcher.runs() if r[1] >= min_length and r[1] >= min_exponent * r[2]]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words outside every run and, of each run, its first period unless another run drops it."""
    if not runs:
        return words
    edge = [0] * (len(words) + 1)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept, depth = [], 0
    for w, d in zip(words, edge):
        depth += d
        if not depth:
            kept.append(w)
    return kept


_words = re.compile(WORD).findall


def split_words(doc_id: int | None, text: str | None) -> list[str]:
    return _words(text or "")


def find_runs(
    docs: DataFrame, split: Callable[[int | None, str | None], list[str]] = split_words, min_length: int = 6, min_exponent: int = 4
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    ``split`` gives a document's words. A null, empty or blank text has no words, no runs and an empty collapsed text.
    Rows stand alone: repeated rows, null ids and ties give one row each; an empty table gives none; columns other than
    doc_id and text aren't read. Texts are taken whole: time grows with n log n words in the worst case, memory with the
    longest text. Nothing is shuffled, and a task that is lost is done again on its own rows.
    """
    schema = T.StructType([docs.select("doc_id").schema[0], *[T.StructField(n, t) for n, t in FOUND]])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for doc_id, text in zip(ids, batch["text"]):
                words = split(doc_id, text)
                runs = runs_of(words, min_length, min_exponent)
                rows.append((len(words), [dict(zip(RUN.names, r)) for r in runs], " ".join(collapse(words, runs))))
            found = pd.DataFrame(rows, columns=[n for n, _ in FOUND])
            found.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            yield found

    return docs.select("doc_id", "text").mapInPandas(search, schema)
