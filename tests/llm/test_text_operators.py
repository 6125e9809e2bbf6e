"""Language ID, quality rules, BPE, toxicity, personal data and the quality classifier."""

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
from helpers import SCHEMA, awkward, count, prose, row, table, words

from listmill.llm import bpe, language_id, pii, quality_classifier, quality_rules, toxicity
from listmill.llm.queries import public_ranks

ENGLISH = "the and that with this from they have were which their would there about".split()
GERMAN = "der und das mit nicht eine werden haben sich durch gegen schön über straße".split()


def bilingual(n, seed=0):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(w) for _ in range(rng.randrange(5, 40))), lang) for _ in range(n) for w, lang in ((ENGLISH, "en"), (GERMAN, "de"))]


def test_unlabelled_texts_are_not_rejected(spark):
    docs = table(spark, [row(1, "plain text", lang=None), row(2, "123 !", lang=None), row(3, None, lang=None)])
    got = {r.doc_id: (r.lang_pred, r.lang_score, r.lang_rejected) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert got == {1: ("und", 0.0, False), 2: ("und", 0.0, True), 3: ("und", 0.0, True)}


def test_language_is_learned_and_edges_are_defined(spark):
    rows = bilingual(120)
    model = language_id.train([t for t, _ in rows], [g for _, g in rows])
    fresh = bilingual(60, seed=9)
    assert np.mean([language_id.predict(model, t)[0] == g for t, g in fresh]) > 0.97
    docs = table(spark, awkward())
    got = {(r.doc_id, r.text): r for r in language_id.identify(docs, model).collect()}
    assert len(language_id.identify(docs, model).collect()) == len(awkward())
    for (_, text), r in got.items():
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred in ("en", "de")) == letters and (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
        assert r.score == "y" and (letters or r.lang_rejected)
    assert language_id.identify(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert language_id.fit(spark.createDataFrame([], SCHEMA)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def brute_base(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = count([(x,) for x in windows])
    repeated = {i + k for i, x in enumerate(windows) if times[(x,)] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_base_rules_equal_brute_force():
    rng = random.Random(2)
    texts = [r[1] for r in awkward() if r[1] is None or len(r[1]) < 5000]
    texts += ["".join(rng.choice(["a", "b", "c#", " ", " ", "\n", "\x0b", "é", " "]) for _ in range(rng.randrange(300))) for _ in range(60)]
    for t in texts:
        assert quality_rules.base_counts(t) == brute_base(t)


def test_bucket_counts_add_up_over_partitions(spark):
    docs = table(spark, awkward(), 5)
    want = sum(np.bincount(quality_rules.buckets(r[1]), minlength=1 << quality_rules.BITS) for r in awkward() if r[1])
    assert (quality_rules.bucket_counts(docs) == want).all()
    assert not quality_rules.bucket_counts(docs.limit(0)).any()


def test_quality_verdicts(spark):
    rng = random.Random(4)
    good = [row(i, prose(rng, 90)) for i in range(40)]
    bad = [row(100 + i, " ".join(w + "%%%" for w in prose(rng, 90).split())) for i in range(10)]
    docs = table(spark, good + bad + awkward())
    # the ratio of the fitted tables equals one computed in one piece
    trusted = table(spark, good)
    fitted = quality_rules.fit(docs, trusted)
    one = lambda rows: sum((np.bincount(quality_rules.buckets(r[1]), minlength=1 << quality_rules.BITS) for r in rows if r[1]), np.zeros(1 << quality_rules.BITS, int))
    assert np.array_equal(fitted, quality_rules.ratios(one(good), one(good + bad + awkward())))
    got = quality_rules.judge(docs, fitted).collect()
    assert len(got) == len(good + bad + awkward())
    verdict = {}
    for r in got:
        verdict.setdefault(r.doc_id, []).append(r)
    assert not any(r.kept for i in range(100, 110) for r in verdict[i])
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    labels = spark.createDataFrame([(i, 1 if i < 40 else 0) for i in range(110)], "doc_id long, quality int")
    assert quality_rules.trusted_texts(table(spark, good + bad), labels).count() == 40
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA), fitted).count() == 0


def test_bpe_equals_the_public_library(spark):
    ranks, pattern = public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = bpe.Encoder(ranks, pattern), random.Random(1)
    texts = ["".join(rng.choice("abcdefgh éèüß 12 \n\t 'stll!#漢🙂") for _ in range(rng.randrange(80))) for _ in range(800)]
    texts += ["a" * 3000, "ab" * 900, "".join(rng.choice("abcdefgh") for _ in range(2000)), "<|endoftext|>"]
    assert [encoder(t) for t in texts] == [library.encode_ordinary(t) for t in texts]
    short = [r for r in awkward() if r[1] is None or len(r[1]) < 90_000]
    got = bpe.digests(table(spark, short), ranks, pattern).collect()
    want = []
    for r in short:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert count(got) == count(want)
    assert encoder("x" * 100_000) == bpe.Encoder(ranks, pattern)("x" * 100_000)
    assert bpe.digests(spark.createDataFrame([], SCHEMA), ranks, pattern).count() == 0


def toxic_rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = prose(rng, rng.randrange(10, 60)).split()
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "you", "zzgrubby", "scum"]))
            w.append("zzgrubby")
        out.append((row(i, " ".join(w)), int(i % 4 == 0)))
    return out


def test_toxicity_is_learned_and_edges_are_defined(spark):
    rows = toxic_rows(900)
    docs, labels = table(spark, [r for r, _ in rows]), spark.createDataFrame([(r[0], y) for r, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "zzgrubby" in model.lexicon.weights
    fresh = toxic_rows(200, seed=8)
    got = {r.doc_id: r.toxicity for r in toxicity.rate(table(spark, [r for r, _ in fresh]), model).collect()}
    assert np.mean([(got[r[0]] >= 0.5) == y for r, y in fresh]) > 0.97
    edge = toxicity.rate(table(spark, awkward()), model).collect()
    assert len(edge) == len(awkward()) and all(0 <= r.toxicity < 0.5 for r in edge)
    assert toxicity.rate(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert toxicity.fit(docs, labels.where("false")) is None


def test_isotonic_fit_is_monotone_and_pools():
    x, p = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4], x, p), [0, 0.5, 0.5, 1])


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a.b", "@", "x-y", ".", "com", " ", "1", "25", "255.", "4111 1111 1111 1111", "4111111111111111", "+1 (415) 555-2671", "10.0.0.1", "é", "\n", "-", "+", "256.1.1.1", "@mail.org"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_checks_context_and_edges(spark):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert kinds("account DE89 3704 0044 0532 0130 00 ok") == ["iban"] and kinds("account DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    docs = table(spark, awkward() + [row(50, "mail é me.x@mail.example.org or +1 (415) 555-2671")])
    got = pii.detect(docs).collect()
    assert len(got) == len(awkward()) + 1
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in got if r.pii} == {50: [("email", 7, 28), ("phone", 32, 49)]}
    assert pii.detect(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "+" * 200_000, "@" * 100_000, "a.b-" * 50_000, "(at)" * 20_000, "A1" * 50_000])
def test_pii_takes_time_in_proportion(text):
    pii.find(text)


def test_quality_classifier(spark):
    rng = random.Random(6)
    docs = [(row(i, prose(rng, 100) if i % 3 else " ".join(w + "###" for w in prose(rng, 100).split())), int(i % 3 > 0)) for i in range(600)]
    labels = spark.createDataFrame([(r[0], y) for r, y in docs], "doc_id long, quality int")
    model = quality_classifier.fit(table(spark, [r for r, _ in docs]), labels)
    got = {r.doc_id: r.quality for r in quality_classifier.rate(table(spark, [r for r, _ in docs]), model).collect()}
    assert np.mean([(got[r[0]] >= 0.3) == y for r, y in docs]) > 0.98
    edge = quality_classifier.rate(table(spark, awkward()), model).collect()
    assert len(edge) == len(awkward()) and all(0 <= r.quality <= 1 for r in edge)
    assert quality_classifier.rate(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert quality_classifier.fit(table(spark, [r for r, _ in docs]), labels.where("false")) is None


def test_attention_gradients_equal_differences():
    rng = np.random.default_rng(0)
    bags, y = [rng.normal(size=(k, 5)) for k in (1, 3, 2)], np.array([0.0, 1, 1])
    w = {"e": rng.normal(size=(5, 4)), "eb": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "cb": np.zeros(())}
    model, x, begins = quality_classifier.PassageModel(np.zeros(5), np.ones(5), w), np.vstack(bags), np.array([0, 1, 4])
    loss = lambda: float(-(y * np.log(p := model.forward(x, begins)["p"]) + (1 - y) * np.log(1 - p)).mean())
    g = model.gradients(x, begins, y)
    for k, v in w.items():
        at = tuple(0 for _ in v.shape)
        keep = v[at].copy()
        v[at] = keep + 1e-5
        up = loss()
        v[at] = keep - 1e-5
        down = loss()
        v[at] = keep
        assert abs((up - down) / 2e-5 - np.asarray(g[k])[at]) < 1e-6
