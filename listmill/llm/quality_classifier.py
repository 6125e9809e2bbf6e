"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_ngrams, labelled, word_hashes

PASSAGE_WORDS = 64
BITS = 8
ORDERS = (1, 2, 3)
DENSE = 8
CLIP = 5.0
# kinds of bytes: other, capital, digit, symbol, mark, part of a longer code point
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", range(128, 256)), 1):
    _KIND[list(_bytes)] = _k
HIDDEN = 24
GATE = 16


def passages(text: str | None) -> np.ndarray:
    """One row of features for every passage of 64 words of the whole text; a text without words has one row of zeros.

    A passage is seen as square roots of hashed byte n-gram shares, and as shares of capitals, digits, symbols, marks
    and non-ASCII bytes, word length, the share of its word triples that the text had before, and of words said twice in a row.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    hashes, starts = word_hashes(data)
    if not len(starts):
        return np.zeros((1, (1 << BITS) + DENSE), np.float32)
    n = (len(starts) - 1) // PASSAGE_WORDS + 1
    edges = starts[::PASSAGE_WORDS].copy()
    edges[0] = 0
    where = np.repeat(np.arange(n), np.diff(np.append(edges, len(data))))
    keys = np.concatenate([(where[: len(ids)] << BITS) + ids for ids in (byte_ngrams(data, order, BITS) for order in ORDERS)])
    grams = np.bincount(keys, minlength=n << BITS).reshape(n, -1).astype(np.float32)
    grams = np.sqrt(grams / np.maximum(1, grams.sum(axis=1, keepdims=True)))
    kinds = np.bincount((where << 3) + _KIND[data], minlength=n << 3).reshape(n, 8)
    size = kinds.sum(axis=1)
    triples = hashes[:-2] * np.uint64(3) + (hashes[1:-1] << np.uint64(1)) + hashes[2:] if len(hashes) > 2 else hashes[:0]
    seen = np.ones(len(triples), bool)
    seen[np.unique(triples, return_index=True)[1]] = False
    twice = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    per = lambda flags: np.bincount(np.flatnonzero(flags) // PASSAGE_WORDS, minlength=n)[:n]
    words = np.bincount(np.arange(len(starts)) // PASSAGE_WORDS, minlength=n)
    dense = np.column_stack([kinds[:, 1:6] / size[:, None], size / words / 20, per(seen) / words, per(twice) / words])
    return np.hstack([grams, dense]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class PassageModel:
    """Weights: ``e`` encodes a passage, ``v`` and ``u`` gate it, ``w`` weighs it, ``c`` scores the weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -CLIP, CLIP)

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """x: the passages of all documents one after the other; begins: where each document's first passage is."""
        p = self.weights
        counts = np.diff(np.append(begins, len(x)))
        h = np.tanh(x @ p["e"] + p["eb"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, begins), counts))
        a /= np.repeat(np.add.reduceat(a, begins), counts)
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ p["c"] + p["cb"]), "counts": counts}

    def gradients(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, begins)
        out = (f["p"] - y) / len(y)
        dz = np.repeat(out[:, None] * p["c"], f["counts"], axis=0)
        da = (f["h"] * dz).sum(axis=1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begins), f["counts"]))
        gate = da[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {
            "e": x.T @ dh, "eb": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ out, "cb": out.sum(),
        }

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        x = self.standard(np.vstack(bags))
        return self.forward(x, np.cumsum([0] + [len(b) for b in bags[:-1]]))["p"]


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.003, batch: int = 64, decay: float = 1e-4, seed: int = 3) -> PassageModel:
    """Mini-batch gradient descent with Adam steps on the log loss of the document labels."""
    rng = np.random.default_rng(seed)
    every = np.vstack(bags)
    mean, scale = every.mean(axis=0), 1 / (every.std(axis=0) + 0.01)
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float64)
    w = {"e": draw(every.shape[1], HIDDEN), "eb": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "cb": np.zeros(())}
    model = PassageModel(mean, scale, w)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            x = model.standard(np.vstack([bags[k] for k in some]))
            g = model.gradients(x, np.cumsum([0] + [len(bags[k]) for k in some[:-1]]), y[some])
            step += 1
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                w[k] = w[k] * (1 - rate * decay) - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, folds: int = 5, held: int = 0) -> PassageModel | None:
    """A model from at most ``max_rows`` documents of ``labels.quality`` outside the held-out remainder (hashed id order)."""
    rows = sorted(labelled(docs, labels, "quality", max_rows, folds, held, seed=10).limit(max_rows).collect(), key=lambda r: (r.doc_id, r.y, r.text or ""))
    return train([passages(r.text) for r in rows], np.array([r.y for r in rows], float)) if rows else None


def rate(docs: DataFrame, model: PassageModel | None) -> DataFrame:
    """One row per document: doc_id and quality (0 to 1) of the whole text, null and empty texts included.

    Rows stand alone: repeated rows get equal scores, a null doc_id stays null, other columns aren't read, no rows give
    no rows. Without a model every score is 0.
    """

    @F.pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        # one document at a time: memory stays that of the longest text, and a score doesn't depend on its neighbours
        return pd.Series([float(model.score([passages(t)])[0]) for t in texts], dtype="float64")

    return docs.select("doc_id", good("text").alias("quality"))
