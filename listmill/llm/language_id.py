"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, bounded_sample, byte_ngrams

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BITS = 15
DIM = 16
# everything that is no ASCII letter and no part of a longer code point becomes a word boundary
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # buckets x labels: the embedding of a bucket times the output weights
    bias: np.ndarray
    sharpness: float = 1.0
    reject_below: float = 0.0


def has_letter(text: str | None) -> bool:
    return text is not None and next((True for c in text if c.isalpha()), False)


def subwords(text: str) -> np.ndarray:
    """Buckets of the byte n-grams inside words, one boundary mark on either side included."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    gap = data == 32
    out = []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        keep = ~(gap[:m] & gap[1 : m + 1])
        for k in range(1, n - 1):
            keep &= ~gap[k : k + m]
        out.append(byte_ngrams(data, n, BITS)[keep])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> LanguageModel | None:
    """Plain SGD on four of five samples; the fifth sets the sharpness of the softmax and the rejection threshold.

    The threshold is the score that one in a thousand rightly named texts falls below, and never over one half.
    """
    rows = [(np.unique(ids, return_counts=True), lang) for t, lang in zip(texts, langs) if has_letter(t) and len(ids := subwords(t))]
    if not rows:
        return None
    labels = sorted({lang for _, lang in rows})
    ys = np.array([labels.index(lang) for _, lang in rows])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.3, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (len(labels), DIM)).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            (ids, n), _ = rows[i]
            w = (n / n.sum()).astype(np.float32)
            mean = w @ emb[ids]
            g = _softmax(out @ mean + bias)
            g[ys[i]] -= 1
            back = out.T @ g
            out -= step * np.outer(g, mean)
            bias -= step * 0.1 * g
            # the gradient of a bucket is scaled to its share of the text's largest share, so that rare ones also move
            emb[ids] -= step * np.outer(w / w.max(), back)
    model = LanguageModel(labels, (emb @ out.T).astype(np.float32), bias)
    calib = np.flatnonzero(held) if held.any() else fit
    z = np.array([(n / n.sum()) @ model.logits[ids] + bias for (ids, n), _ in (rows[i] for i in calib)])
    y = ys[calib]
    loss = {s: -np.log(_softmax(z * s)[np.arange(len(y)), y] + 1e-9).mean() for s in np.geomspace(0.1, 20, 40)}
    model.sharpness = float(min(loss, key=loss.get))
    p = _softmax(z * model.sharpness)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.reject_below = float(min(0.5, right[len(right) // 1000])) if len(right) else 0.0
    return model


def predict(model: LanguageModel | None, text: str | None) -> tuple[str, float, bool]:
    """(language, calibrated probability, rejected) of a whole text."""
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0, not has_letter(text)
    ids = subwords(text)
    # a text whose only letters lie outside words of n-gram length still gets the prior of the bias
    z = (model.logits[ids].mean(axis=0, dtype=np.float64) if len(ids) else 0.0) + model.bias
    p = _softmax(z * model.sharpness)
    k = int(p.argmax())
    return model.labels[k], float(p[k]), bool(p[k] < model.reject_below)


def fit(docs: DataFrame, max_rows: int = 4000, seed: int = 1) -> LanguageModel | None:
    """A model from ``text`` and non-null ``lang`` of at most ``max_rows`` rows of ``docs`` (picked by hashed id)."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sorted(bounded_sample(known, "doc_id", max_rows, seed).collect(), key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` plus lang_pred, lang_score and lang_rejected, replacing columns of those names.

    Null texts and texts without a letter are ``und``, score 0, rejected. Without a model, as ``fit`` gives none where
    no row has both a language and a letter, all other texts are ``und``, score 0, not rejected. With one, each gets a
    learned language; it is rejected when its calibrated probability lies under the model's threshold. Each row stands
    alone, so repeated rows, long texts (read whole) and ties (the label that sorts first) need nothing more; an empty
    table gives none.
    """

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def name(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(model, t) for t in texts], columns=["lang_pred", "lang_score", "lang_rejected"])

    found = name(F.col("text"))
    new = ["lang_pred", "lang_score", "lang_rejected"]
    base, back = aside(docs.drop(*new), "text")
    return back(base.select("*", found.alias("__lang")), "__lang.*")
