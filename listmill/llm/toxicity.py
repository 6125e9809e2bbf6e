"""Toxicity: gradient-boosted trees over a few dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled

# Common insults to begin with, forms of address in four languages, usual stand-ins for letters.
SEEDS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "dumb", "garbage", "imbecile"]
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "euch", "usted", "ustedes", "tú", "ti", "vosotros"}
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

SEED_WEIGHT = 4.0
STEMS = (4, 5, 6)
NEAR = 5
FEATURES = [
    "lexicon_density", "lexicon_hits", "lexicon_top", "stem_density", "stem_hits", "stem_top", "second_person_near", "capitals", "shouted_words",
    "punctuation", "exclamations", "symbols", "obfuscated_hits", "obfuscated_words", "stretched_words", "digits", "length",
]
_WORDS = re.compile(r"\w+")
_TOKEN = re.compile(r"\S*")
_MIXED = re.compile(r"[\d@$!|*.-]+[^\W\d_]")
# classes of bytes: other, lower, upper, digit, space, symbol, exclamation mark, inside of a code point, start of one
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"!", range(128, 192), range(192, 256)), 1):
    _KIND[list(_bytes)] = _k


def terms(text: str) -> set[str]:
    """Lexicon entries that a text supports: its words, and ``stem*`` for the beginnings of longer words."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def learn_lexicon(rows: DataFrame, min_docs: int = 6, min_weight: float = 3.0, most: int = 4000) -> dict[str, float]:
    """Smoothed log odds of the terms that mark toxic texts among ``rows`` (text, y), at most ``most`` of them.

    Partitions count documents by term on their own; Spark adds up, filters and ranks, and only the ranking's top comes back.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, clean = Counter(), Counter()
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"]):
                (bad if y else clean).update(terms(t or ""))
        every = list(bad | clean)
        yield pd.DataFrame({"term": every, "bad": [bad[k] for k in every], "clean": [clean[k] for k in every]}).astype({"bad": "int64", "clean": "int64"})

    totals = rows.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("clean")).first()
    if not totals.bad or not totals.clean:
        return {}
    weight = F.log((F.col("bad") + 0.5) / (F.lit(totals.bad) + 1)) - F.log((F.col("clean") + 0.5) / (F.lit(totals.clean) + 1))
    top = (
        rows.select("text", "y").mapInPandas(count, "term string, bad long, clean long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
        .where(F.col("bad") >= min_docs).withColumn("weight", weight).where(F.col("weight") >= min_weight)
        .orderBy(F.desc("bad"), F.desc("weight"), "term").limit(most)
    )
    return {r.term: float(r.weight) for r in top.collect()}


class Lexicon:
    """Weighted words and stems; ``starts`` has the first four letters of each, which rules out nearly every word at once."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.starts = {k.rstrip("*")[:4] for k in weights}

    def word(self, w: str) -> float:
        return self.weights.get(w, 0.0)

    def stem(self, w: str) -> float:
        get = self.weights.get
        return max(get(w[:4] + "*", 0.0), get(w[:5] + "*", 0.0), get(w[:6] + "*", 0.0))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text; all zero for a null or empty one."""
    text = text or ""
    low = text.lower()
    words = _WORDS.findall(low)
    n, starts = max(1, len(words)), lexicon.starts
    known = [(i, w) for i, w in enumerate(words) if w[:4] in starts]
    hits = [(i, s) for i, w in known if (s := lexicon.word(w))]
    stems = [s for _, w in known if (s := lexicon.stem(w))]
    near = 0
    if hits:
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON] or [-10 * NEAR])
        at = np.array([i for i, _ in hits])
        where = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.clip(where, 0, len(you) - 1)]), np.abs(at - you[np.clip(where - 1, 0, len(you) - 1)]))
        near = int((gap <= NEAR).sum())
    mixed = hidden = 0
    end = 0
    for m in _MIXED.finditer(low):
        if m.start() <= end or not low[m.start() - 1].isalpha():
            continue
        start, end = max(low.rfind(" ", 0, m.start()), low.rfind("\n", 0, m.start())) + 1, m.end()
        token = _TOKEN.match(low, start)[0]
        end = start + len(token)
        mixed += 1
        plain = "".join(c for c in token.translate(STAND_INS) if c.isalpha())
        hidden += bool(lexicon.word(plain) or lexicon.stem(plain))
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = _KIND[data]
    other, lower, upper, digits, spaces, symbols, shouts, inner, wide = np.bincount(kind, minlength=9)[:9].tolist()
    size = max(1, len(text))
    capital = kind == 2
    shouted = int((capital[1:] & capital[:-1] & ~np.concatenate([[False], capital[:-2]])).sum()) if len(kind) > 2 else 0
    letter = (kind == 1) | capital
    stretched = int(((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]).sum()) if len(kind) > 2 else 0
    return [
        sum(s for _, s in hits) / n, np.log1p(len(hits)), max((s for _, s in hits), default=0.0), sum(stems) / n, np.log1p(len(stems)), max(stems, default=0.0),
        near / n, upper / max(1, upper + lower + wide), shouted / n, (other + symbols + shouts) / size, shouts / n, symbols / n,
        np.log1p(hidden), mixed / n, stretched / n, digits / size, np.log1p(len(words)),
    ]


@dataclass
class Trees:
    """Boosted trees of equal depth over binned features, stored as heaps."""

    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def leaves(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[np.arange(len(b)), tree[0][node]] > tree[1][node])
        return node - (2**self.depth - 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + sum((t[2][self.leaves(b, t)] for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 32, penalty: float = 5.0) -> Trees:
    """Newton boosting of the log loss; a node splits at the bin of the largest gain, or not at all when none gains."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins)[1:-1])) for j in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(p / (1 - p))), depth)
    b = model.bins(x)
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        node, first = np.zeros(len(y), np.int64), 0
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, n_bins + 1)
        for level in range(depth):
            width = 2**level
            gain = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                key = (node - first) * (n_bins + 1) + b[:, j]
                gs = np.bincount(key, g, width * (n_bins + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(key, h, width * (n_bins + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                best = value.argmax(axis=1)
                better = value[np.arange(width), best] > gain
                gain[better] = value[np.arange(width), best][better]
                feature[first : first + width][better], cut[first : first + width][better] = j, best[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            first = 2 * first + 1
        leaf = node - first
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        model.trees.append((feature, cut, value))
        f += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the best non-decreasing fit: neighbours that violate the order are pooled."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []  # sum of y, count, first and last score
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            v2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], last]
    xs = np.array([e for k in blocks for e in (k[2], k[3])])
    return xs, np.array([k[0] / k[1] for k in blocks for _ in range(2)])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.knots)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20000, folds: int = 5, held: int = 0) -> ToxicityModel | None:
    """A model from at most ``max_rows`` documents of ``labels.toxic`` outside the held-out remainder (hashed id order).

    Half of them give the lexicon, a third the trees, the rest the calibration, so that none judges its own fit. None
    without labelled rows.
    """
    rows = labelled(docs, labels, "toxic", max_rows, folds, held, seed=4)
    part = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(12))
    lexicon = Lexicon({s: SEED_WEIGHT for s in SEEDS} | learn_lexicon(rows.where(part < 6)))

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon) for t in texts])

    got = sorted(rows.where(part >= 6).select("doc_id", (part >= 10).alias("calib"), "y", dense("text").alias("x")).limit(max_rows).collect(), key=lambda r: (r.doc_id, r.y, r.x))
    if not got:
        return None
    x, y, calib = np.array([r.x for r in got], float), np.array([r.y for r in got], float), np.array([r.calib for r in got])
    if calib.sum() < 50 or (~calib).sum() < 50:
        calib = np.ones(len(got), bool)
        trees = boost(x, y)
    else:
        trees = boost(x[~calib], y[~calib])
    return ToxicityModel(lexicon, trees, isotonic(trees.raw(x[calib]), y[calib]))


def rate(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """One row per document: doc_id and toxicity (0 to 1) of the whole text, null and empty texts included.

    Rows stand alone: repeated rows get equal scores, a null doc_id stays null, other columns aren't read, no rows give
    no rows. Without a model every score is 0.
    """

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(np.clip(model.score(np.array([features(t, model.lexicon) for t in texts], float)), 0, 1))

    return docs.select("doc_id", toxic("text").alias("toxicity"))
