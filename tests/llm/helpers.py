"""Small tables with every awkward row, and brute-force statements of the rules."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, token int, label int, score string, kept int, size string, line int, wanted int"
WORDS = "the of and river stone quiet market between lantern carried morning harvest bridge window distant gather winter silver paper garden".split()
LONG = "word " * 30_000


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "y", 3, "z", 4, 5)


def awkward():
    rng = random.Random(5)
    base = [prose(rng, 80) for _ in range(4)]
    texts = [None, "", " \n\t ", "!!! 123", "one", "two words", "a b c d", "a b c d", LONG, "x" * 100_000, base[0], base[0], base[1], base[1] + " end", base[2], base[3], "é ü 漢字 🙂"]
    rows = [row(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "ab"[i % 2]) for i, t in enumerate(texts)]
    return rows + [row(10, base[0]), row(None, base[2]), row(None, None), row(3, "!!! 123")]


def table(spark, rows, slices=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(slices)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(n, linked):
    """Smallest member of each index's connected group, given a test on pairs of indices."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(n)]


def levenshtein(a, b):
    row_ = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row_[0] = row_[0], i
        for j, y in enumerate(b, 1):
            last, row_[j] = row_[j], min(row_[j] + 1, row_[j - 1] + 1, last + (x != y))
    return row_[-1]


def count(rows):
    return Counter(map(tuple, rows))
