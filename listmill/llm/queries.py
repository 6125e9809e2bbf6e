"""Named queries of the operators, each over its whole table, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe, decontamination, exact_dedup, language_id, line_dedup, mixing, ngram_jaccard, periodic_runs, pii, quality_classifier, quality_rules, token_alignment, toxicity
from .common import read, remainder

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_language_id")
def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held, "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


@query("op2_quality_rules")
def op2(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    table = quality_rules.fit(docs, quality_rules.trusted_texts(docs, read(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, table)


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Rank map and word pattern of an installed public tokenizer."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def op3(spark, sf_dir: str) -> DataFrame:
    return bpe.digests(read(prepare(spark), sf_dir, "documents"), *public_ranks())


@query("op4_toxicity")
def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    scored = toxicity.rate(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query("op5_pii")
def op5(spark, sf_dir: str) -> DataFrame:
    found = pii.detect(read(prepare(spark), sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(pii.BASE_KINDS))
    number = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.BASE_KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


_OP6_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query("op6_exact_dedup", _OP6_SQL)
def op6(spark, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(prepare(spark), f"{sf_dir}/documents.parquet")


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place,
             CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             / CAST((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
g AS (SELECT source, source_size, CASE WHEN level * weight <= cap
             THEN (SELECT arg_min(level, place) FROM l WHERE level * weight <= cap) * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l),
h AS (SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0)) AS BIGINT) AS whole FROM g),
r AS (SELECT d.*, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, size, source_size, target, whole * size + greatest(0, least(size, rest - gone)) AS taken FROM r
"""


@query("op8_mixing", _OP8_SQL)
def op8(spark, sf_dir: str) -> DataFrame:
    return mixing.mix(read(prepare(spark), sf_dir, "documents")).drop("text_hash")


@query("op10_quality_classifier")
def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    scored = quality_classifier.rate(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))
    score = F.col("quality")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query("op7_line_dedup")
def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    out = line_dedup.dedup(docs, whole=True)
    kept = F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", kept.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op9_ngram_jaccard")
def op9(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard.component_ids(read(prepare(spark), sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def tiled_words(doc_id: int | None, text: str | None) -> list[str]:
    """The words of a text; of one document in ten, picked by id, those from some word on repeat with a period."""
    words = periodic_runs.split_words(doc_id, text)
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


@query("op11_periodic_runs")
def op11(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read(prepare(spark), sf_dir, "documents"), tiled_words)
    # exact comparison of length / period; runs come by start and period, so the first of equals stays
    beats = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast(periodic_runs.RUN)
    top = found.withColumn("top", F.aggregate("runs", none, lambda best, r: F.when(beats(r, best), r).otherwise(best)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


_OP12_SQL = r"""
WITH w AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
           UNION ALL
           SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id, ws, least(10, len(ws)) AS m FROM w WHERE kind = 'b' AND len(ws) > 0),
phrases AS (SELECT DISTINCT id, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM items)),
docs AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE kind = 'd'),
hits AS (SELECT r, i, p.m, p.id FROM (SELECT r, i, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM docs, (SELECT DISTINCT m FROM items) WHERE i + m - 1 <= len(ws)) d JOIN phrases p USING (m, phrase)),
places AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, m, unnest(range(0, m)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, id FROM hits WHERE id IS NOT NULL) GROUP BY r)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (r) LEFT JOIN found USING (r) WHERE kind = 'd'
"""


@query("op12_decontamination", _OP12_SQL)
def op12(spark, sf_dir: str) -> DataFrame:
    found = decontamination.search(read(prepare(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op13_token_alignment")
def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.alignments(read(prepare(spark), sf_dir, "documents"), *paths)[0]
