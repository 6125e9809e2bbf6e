"""De-duplication, mixing, the n-gram join and the pipeline."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
from helpers import SCHEMA, awkward, count, grouped, levenshtein, prose, row, shingle_set, table, words
from pyspark.sql import functions as F

import corpus_pipeline
from listmill.llm import exact_dedup, language_id, line_dedup, linkage, mixing, ngram_jaccard
from listmill.llm.common import SPACES, sieve
from listmill.llm.queries import _OP8_SQL


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [row(i, rng.choice(["a b", "ab", " ab", "a  b", "c", "", None, "A b", "d e f"])) for i in range(60)] + awkward()
    path = str(tmp_path / "docs.parquet")
    table(spark, rows, 5).write.parquet(path)
    weak = lambda t: F.length(t).cast("string")
    for digest, files in ((exact_dedup.sha256, 2), (weak, 1000)):
        got = exact_dedup.dedup(spark, path, digest, files).collect()
        assert len(got) == len(rows)
        want = {}
        for r in rows:
            want.setdefault(plain(r[1]), []).append(((-len(r[1] or ""), r[0] is None, r[0] or 0), r[0]))
        by_hash = {}
        for r in got:
            by_hash.setdefault(r.text_sha256, []).append(r)
        assert len(by_hash) == len(want)
        assert sorted((len(v), min(v)[1] if min(v)[1] is not None else -1) for v in want.values()) == sorted(
            (v[0].group_size, v[0].keep_id if v[0].keep_id is not None else -1) for v in by_hash.values()
        )
        for v in by_hash.values():
            assert {r.group_size for r in v} == {len(v)} and len({r.keep_id for r in v}) == 1 and sum(r.kept for r in v) == 1
    empty = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert exact_dedup.dedup(spark, empty).count() == 0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(["pebble", "thistle", "copper"])
    return " ".join(w)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(20, 60)) for _ in range(6)]
    docs = [row(i, "\n".join(rng.choice([rng.choice(base), edited(rng, rng.choice(base), 1), "short line", "", "  " + rng.choice(base).upper()]) for _ in range(4))) for i in range(30)]
    docs += awkward()
    df = table(spark, docs)
    sims = {r.key: r for r in line_dedup.simhashes(line_dedup.lines_of(df)).collect()}
    places = sorted(
        {((r[0] is not None, r[0] or 0, h), k, line.strip(SPACES).lower()) for r, h in zip(docs, hashes(spark, docs)) for k, line in enumerate((r[1] or "").split("\n")) if len(line.strip(SPACES).split(" ")) >= 5}
    )
    keys = hashes_of(spark, [p[2] for p in places])

    def linked(i, j):
        a, b = places[i][2], places[j][2]
        near = bin((sims[keys[i]].sim ^ sims[keys[j]].sim) & (2**64 - 1)).count("1") <= 3
        return a == b or (near and abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and levenshtein(a, b) * 10 <= max(len(a), len(b)))

    top = grouped(len(places), linked)
    gone = {}
    for i, (p, k, _) in enumerate(places):
        if top[i] != i:
            gone.setdefault(p, set()).add(k)
    want = []
    for r, h in zip(docs, hashes(spark, docs)):
        drop = gone.get((r[0] is not None, r[0] or 0, h), set())
        want.append((r[0], r[1] if not drop else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in drop), *r[2:]))
    out = line_dedup.dedup(df)
    assert out.columns == df.columns and count(out.collect()) == count(want)
    assert any(w[1] != r[1] for w, r in zip(want, docs))
    fuzzy = {i for i in range(len(places)) if top[i] != i and places[top[i]][2] != places[i][2]}
    assert fuzzy, "the fixture has lines that are alike but not equal"
    assert line_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def misspelt(rng, text, n):
    c = list(text)
    for p in rng.sample([k for k, x in enumerate(c) if x != " "], n):
        c[p] = rng.choice("qxz")
    return "".join(c)


def test_line_candidates_find_what_edit_distance_links(spark):
    """Recall of candidates against plain edit distance, on lines of 5 to 60 words of random letters."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 10)))
    least = {"one": 0.99, "5%": 0.8, "10%": 0.4}
    rows = []
    for i in range(100):
        a = " ".join(word() for _ in range(5 + i * 55 // 99))
        for name, n in (("one", 1), ("5%", max(1, len(a) // 20)), ("10%", len(a) // 10)):
            b = misspelt(rng, a, n)
            if 0 < levenshtein(a, b) * 10 <= max(len(a), len(b)):
                rows.append((name, a, b))
    df = spark.createDataFrame(rows, "name string, a string, b string")
    lines = df.select(F.explode(F.array("a", "b")).alias("plain")).distinct().select(F.xxhash64("plain").alias("key"), F.length("plain").alias("size"), "plain")
    tokens = line_dedup.line_tokens(lines).groupBy("node").agg(F.collect_set("token").alias("t")).collect()
    tokens = {r.node: set(r.t) for r in tokens}
    keys = dict(zip(both := sorted({x for r in rows for x in r[1:]}), hashes_of(spark, both)))
    for name, share in least.items():
        met = [bool(tokens.get(keys[a], set()) & tokens.get(keys[b], set())) for n, a, b in rows if n == name]
        assert len(met) > 80 and np.mean(met) >= share, (name, np.mean(met))


def test_a_misspelt_line_goes(spark):
    rng = random.Random(12)
    lines = [prose(rng, 5 + k) for k in range(0, 56, 5)]
    df = table(spark, [row(k, line) for k, line in enumerate(lines)] + [row(100 + k, misspelt(rng, line, 1)) for k, line in enumerate(lines)])
    out = {r.doc_id: r.text for r in line_dedup.dedup(df, whole=True).collect()}
    assert [out[k] for k in range(len(lines))] == lines and {out[100 + k] for k in range(len(lines))} == {""}


def test_short_and_blank_free_lines_go(spark):
    long = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(60))
    first, again = ["Home", "a\tb", "", "contact us today", long], ["home ", "A\tB", "", "contact us todey", long[:30] + "x" + long[31:]]
    df = table(spark, [row(1, "\n".join(first)), row(2, "\n".join(again)), row(3, "hole\n\nhome")])
    out = {r.doc_id: r.text for r in line_dedup.dedup(df, whole=True).collect()}
    # four characters allow no edit
    assert out == {1: "\n".join(first), 2: "", 3: "hole\n"}


def hashes(spark, docs):
    return hashes_of(spark, [r[1] for r in docs])


def hashes_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.xxhash64("t").alias("h")).collect()
    return [r.h for r in sorted(rows, key=lambda r: r.i)]


def test_block_tokens_miss_no_near_hash(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    shared = F.arrays_overlap(line_dedup.block_tokens(F.col("a")), line_dedup.block_tokens(F.col("b")))
    assert df.where(~shared).count() == 0


def mix_brute(docs, weights=(1, 2, 3), most=3):
    sizes = {}
    for r in docs:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return sizes, target


def test_mixing_equals_brute_force_and_sql(spark):
    rng = random.Random(2)
    docs = awkward() + [row(100 + i, prose(rng, rng.randrange(1, 90)), source=rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(80)]
    sizes, target = mix_brute(docs)
    df = table(spark, docs)
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert len(got) == len(docs)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    documents = pd.DataFrame(docs, columns=df.columns)  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    sql = duckdb.sql(_OP8_SQL).fetchall()
    assert count(sql) == count((r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got)
    again = mixing.repeat(df).collect()
    per = {}
    for r in again:
        per[r.source] = per.get(r.source, 0) + len(words(r.text))
    assert {s: n for s, n in taken.items() if n} == per
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0 and mixing.repeat(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.target for r in mixing.mix(table(spark, [row(1, None), row(2, "")])).collect()} == {0.0}


def test_the_part_of_a_mixed_text_is_verbatim(spark):
    rng = random.Random(4)
    text = lambda n: "\n".join(prose(rng, 7).replace(" ", "\t  ", 1) for _ in range(n))
    docs = [row(i, " \n" + text(9), source=s) for i, s in enumerate("aabbcc")]
    whole = {r[1] for r in docs}
    parts = [r.text for r in mixing.repeat(table(spark, docs), (2, 3, 4)).collect() if r.text not in whole]
    assert parts and all(any(w.startswith(p) for w in whole) for p in parts)


CLASHING = "__lang __of __of_hash __dropped __id __source __taken __rows __size __hash __copy __part __time text_hash lang_pred lang_score other_0 other_3 row".split()


def test_no_column_of_the_input_clashes_with_inner_ones(spark):
    docs = table(spark, awkward()).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"{c} of ").alias(c) for c in CLASHING])
    docs = docs.select(*[F.concat(c, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) if c in CLASHING else c for c in docs.columns])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
    named = language_id.identify(docs.drop("lang_pred", "lang_score"), None)
    assert named.columns == [c for c in docs.columns if c not in ("lang_pred", "lang_score")] + ["lang_pred", "lang_score", "lang_rejected"]


def near_copies(rng, n):
    base = [prose(rng, k) for k in (4, 6, 7, 8, 9, 12, 15, 40, 90, 200)]
    return [edited(rng, t, rng.randrange(3)) if rng.random() < 0.7 else t.title() for t in (rng.choice(base) for _ in range(n))]


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(4)
    docs = awkward() + [row(1000 + i, t) for i, t in enumerate(near_copies(rng, 160))]
    sets = [shingle_set(r[1]) for r in docs]
    top = grouped(len(docs), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    least = {}
    for i, r in enumerate(docs):
        if r[0] is not None and sets[i]:
            least[top[i]] = min(least.get(top[i], r[0]), r[0])
    want = [(r[0], len(sets[i]), least.get(top[i], r[0]) if sets[i] else r[0]) for i, r in enumerate(docs)]
    df = table(spark, docs, 4)
    got = ngram_jaccard.component_ids(df, bits=10).select("doc_id", "n_shingles", "component_id").collect()
    assert count(got) == count(want)
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns
    stays = kept.collect()
    assert len([r for r in stays if shingle_set(r.text)]) == len({top[i] for i in range(len(docs)) if sets[i]})
    assert len([r for r in stays if not shingle_set(r.text)]) == sum(not s for s in sets)
    assert ngram_jaccard.component_ids(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sets_that_link_share_a_token():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 50, 1024)
    for light in (0, 3, 6, 9, 12):
        for _ in range(400):
            n = int(rng.integers(1, 18))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            drop = rng.random(len(b)) < 0.15
            b[drop] = rng.integers(0, 2**63, int(drop.sum())).astype(np.uint64) * np.uint64(2)
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                assert len(np.intersect1d(ngram_jaccard.tokens(a, sketch, light), ngram_jaccard.tokens(b, sketch, light)))
            differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ngram_jaccard.parity(a), ngram_jaccard.parity(b)))
            assert differ <= len(np.setxor1d(a, b))


def test_boundary_follows_cost():
    assert ngram_jaccard.boundary({3: 10, 4: 10}, 0.0) <= ngram_jaccard.boundary({3: 10, 4: 10, 8: 100}, 1e6)
    assert ngram_jaccard.boundary({}, 5.0) == 0
    for n, m in combinations(range(1, 30), 2):
        assert (m in ngram_jaccard.may_sizes(n)) == (4 * n >= 3 * m)


def test_components_of_stars_chains_and_rings(spark):
    rng = random.Random(0)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    rng.shuffle(edges)
    got = dict(map(tuple, linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 for i in range(31)} | {200 + i: 200 for i in range(9)}
    assert linkage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sieve_keeps_all_wanted(spark):
    df, some = spark.range(5000), spark.range(0, 5000, 7).withColumnRenamed("id", "w")
    got = sieve(df, F.col("id"), some, F.col("w"))
    assert got.join(some, F.col("id") == F.col("w"), "left_semi").count() == some.count() and got.count() < 1000


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    lines = [prose(rng, 12) for _ in range(30)]
    rows = [row(i, "\n".join(rng.sample(lines, 3) + [prose(rng, 30)])) for i in range(40)] + awkward()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0
    assert count(corpus_pipeline.run(spark, str(tmp_path)).collect()) == count(docs.collect())
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
