"""Periodic runs, benchmark decontamination and cross-tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, prose, row, table, words
from pyspark.sql import functions as F

from listmill.llm import decontamination, periodic_runs, queries, token_alignment


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def all_runs(w, min_length, exponent):
    """Every maximal stretch that agrees with itself p places on, under its smallest p."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        x = p
        while x < n:
            e = x
            while e < n and w[e] == w[e - p]:
                e += 1
            if e - x >= p:
                out.setdefault((x - p, e), p)
            x = e + 1
    return sorted((s, e - s, p) for (s, e), p in out.items() if e - s >= min_length and e - s >= exponent * p)


def test_square_catcher_equals_brute_force_after_every_word():
    rng = random.Random(3)
    for _ in range(300):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 3, 8])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            w = [*w[:a], *(w[a + (i - a) % min(p, n - a)] for i in range(a, n))]
        catcher = periodic_runs.SquareCatcher()
        for i, x in enumerate(w, 1):
            catcher.append(x)
            assert catcher.runs() == all_runs(w[:i], 1, 2)
            # a square that ends here has a primitive root, or a smaller one ends here too
            squares = {p for _, p in catcher.squares()}
            assert all((w[i - p : i] == w[i - 2 * p : i - p]) == (p in squares) for p in range(1, i // 2 + 1) if p in squares or not any(p % q == 0 for q in squares))
    assert periodic_runs.runs_of(["a"] * 20_000) == [(0, 20_000, 1)]


def test_collapse_keeps_the_first_period():
    w = "x a b a b a b a b y y y y y y z".split()
    assert " ".join(periodic_runs.collapse(w, periodic_runs.runs_of(w))) == "x a b y z"


def op11_row(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w, 6, 4)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [row(i, prose(rng, rng.randrange(1, 60)) if i % 3 else " ".join(["on and on"] * rng.randrange(2, 9))) for i in range(300)]
    rows += [r for r in awkward() if len(r[1] or "") < 50_000]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(op11_row(r[0], r[1]) for r in rows)
    assert sum(r.n_runs for r in got) > 50
    long_ = periodic_runs.find_runs(table(spark, awkward())).where(F.size("runs") > 0).collect()
    assert [r.runs[0].length for r in long_] == [30_000]
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = leak_words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            phrases.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc_id, text in docs:
        w = leak_words(text)
        hits = [(i, m, phrases[tuple(w[i : i + m])]) for m in sizes for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in phrases]
        hit = {k for i, m, _ in hits for k in range(i, i + m)}
        out.append((doc_id, len(w), frozenset(hit), tuple(sorted({x for *_, of in hits for x in of if x is not None}))))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([3, 8, 12, 40]))) for i in range(12)] + [(3, prose(rng, 15)), (None, prose(rng, 20)), (90, None), (91, " .. "), (92, "Ümlaut 漢字")]
    texts = []
    for k in range(60):
        a, b = rng.choice(items)[1] or "", prose(rng, rng.randrange(0, 40))
        # whole items, parts of them, other case and punctuation between the words
        part = a.split()[: rng.randrange(0, 20)]
        texts.append(rng.choice([b, f"{b}. {a.upper()} {b}", " - ".join(part) + "\n" + b, a + a, b + " " + " ".join(part)]))
    rows = [row(i, t) for i, t in enumerate(texts)] + awkward() + [row(500, None), row(501, "ümlaut 漢字!")]
    docs = table(spark, rows, 4).withColumn("items", F.lit(1)).withColumn("spans", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("spans", F.lit("x"))
    want = Counter(leaks([(r[0], r[1]) for r in rows], items))
    for shard, block in ((1_000_000, 100_000), (100, 60)):
        got = decontamination.search(docs, bench, shard_words=shard, block_words=block, with_text=True).collect()
        seen = [(r.doc_id, r.n_words, frozenset(k for s in r.spans for k in range(s.start, s.end)), tuple(r["items"])) for r in got]
        assert Counter(seen) == want
        assert all(r.n_hit == sum(s.end - s.start for s in r.spans) and len(leak_words(r.cleaned)) == r.n_words - r.n_hit for r in got)
        assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    assert sum(bool(h) for _, _, h, _ in want) > 20
    assert decontamination.search(spark.createDataFrame([], SCHEMA), bench).count() == 0
    none = decontamination.search(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_a_long_item_is_cut_into_pieces_without_losing_a_window(spark):
    rng = random.Random(5)
    text = " ".join(f"w{i}" for i in range(2_500))
    docs = [(i, " ".join(f"w{k}" for k in range(s, s + 10))) for i, s in enumerate([0, 995, 1_000, 1_995, 2_490])] + [(9, prose(rng, 50))]
    got = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(i, 10) for i in range(5)] + [(9, 0)]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    for k in (2, 3, 9):
        s = np.append(rng.integers(0, k, 300), 0)
        index = decontamination.FMIndex(s, k, 4)
        for m in (1, 2, 4):
            phrases = rng.integers(1, k, (20, m))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(s) - m + 1) if (s[i : i + m] == p).all()]


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def op13_rows(rows, paths):
    """The contract read literally: byte ranges, all pairs of tokens that overlap, counts over all rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(paths[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    back = token_alignment.byte_level()
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        bytes_a = [bytes(back[c] for c in a_side.id_to_token(i)) for i in a]
        pieces = [b_side.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            a, b, bytes_a, bytes_b = [], [], [], []

        def ranges(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        ra, rb = ranges(bytes_a), ranges(bytes_b)
        links = [(x, y) for x, (s, e) in zip(a, ra) for y, (t, f) in zip(b, rb) if s < f and t < e]
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, last = [], 0
        for end in ends:
            inside = lambda ids, r: ",".join(str(i) for i, (_, e) in zip(ids, r) if last < e <= end)  # noqa: B023, E731
            groups.append(f"{inside(a, ra)}|{inside(b, rb)}")
            last = end
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, sha(";".join(groups)) if groups else ""))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return Counter((i, n, m, g, len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), h) for i, n, m, g, ls, h in found)


def test_alignment_equals_brute_force(spark, paths):
    rng = random.Random(8)
    odd = ["a  b\t\tc\n\n d", "漢字 と 🙂 é", "<|endoftext|> <s> </s> <unk> <0x41>", " lead", "trail ", "▁x ▁", "x\x00y", "ﬁ ｆｕｌｌ", "!" * 50, "1234567890"]
    texts = odd + [prose(rng, rng.randrange(1, 40)) for _ in range(30)]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(100 + i, texts[5 + i % 3]) for i in range(40)] + [r for r in awkward() if len(r[1] or "") < 5_000]
    want = op13_rows([(r[0], r[1]) for r in rows], paths)
    docs = table(spark, rows, 4).withColumn("digest", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("chunk", F.lit(2))
    for size in (4 << 20, 200):
        out, counts = token_alignment.alignments(docs, *paths, chunk_bytes=size)
        got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())
        assert got == want
        assert counts.agg(F.sum("n")).first()[0] == sum(r[4] * n for r, n in want.items())
    assert token_alignment.alignments(spark.createDataFrame([], SCHEMA), *paths)[0].count() == 0
