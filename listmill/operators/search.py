"""Filters, text search, facets, orders and pages over the listings table."""

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab as V
from ..functions.quality import closed, is_public
from ..functions.text import empty_if_null

SEARCH_FIELDS = ["title", "company", "summary", "location"]


def _accent_table():
    """Accented Latin letters and their base letters, derived from Unicode decompositions."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED.lower(), UNACCENTED.lower())


def fold_word(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(ch))


def query_words(q: str, limit: int = 6) -> list[str]:
    return re.findall(r"\w+", q or "")[:limit]


def active(as_of_date: Column) -> Column:
    return ~closed(F.col("tags"), F.col("expires_at"), as_of_date)


def contains_ci(c: Column, s: str) -> Column:
    return F.contains(F.lower(c), F.lit(s.lower()))


def search_filter(
    jobs: DataFrame, as_of_date: Column, category="", employment="", workplace="", level="", place=""
) -> DataFrame:
    """Open listings that meet every given condition; empty ones and absent columns are skipped."""
    conds = [active(as_of_date)]
    if category:
        conds.append(F.col("category") == category)
    for value, column in ((employment, "employment_type"), (workplace, "remote_status"), (level, "experience_level")):
        if value and column in jobs.columns:
            conds.append(F.col(column) == value)
    if place:
        conds.append(contains_ci(F.col("location"), place))
    return jobs.filter(reduce(lambda a, b: a & b, conds))


# ---- orders and pages; the id settles ties ------------------------------------------
def order_featured():
    return [F.desc("featured"), F.desc("created_at"), F.desc("id")]


def order_newest():
    return [F.desc("created_at"), F.desc("id")]


def order_deadline():
    blank = F.col("expires_at").isNull() | (F.trim("expires_at") == "")
    return [blank.asc(), F.asc_nulls_first("expires_at"), F.desc("created_at"), F.desc("id")]


ORDERS = {"featured": order_featured, "newest": order_newest, "deadline": order_deadline}


def page(df: DataFrame, order, number: int = 1, size: int = V.PAGE_SIZE) -> DataFrame:
    if not 1 <= number <= 1000:
        raise ValueError("page number must be 1 to 1000")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_page(
    jobs: DataFrame, as_of_date: Column, sort="featured", number=1, public_only=True,
    filter_first=False, size=V.PAGE_SIZE, q="", postings: DataFrame | None = None, **filters
) -> DataFrame:
    """One result page. The public test runs on the page's rows, after the limit, unless
    ``filter_first`` asks for full pages of public rows."""
    rows = search_filter(jobs, as_of_date, **filters)
    if query_words(q):
        hits = prefix_hits(build_postings(jobs) if postings is None else postings, q)
        rows = rows.join(hits, "id", "left_semi")
    if public_only and filter_first:
        rows = rows.filter(is_public(rows, as_of_date))
    rows = page(rows, ORDERS.get(sort, order_featured)(), number, size)
    if public_only and not filter_first:
        rows = rows.filter(is_public(rows, as_of_date))
    return rows


def page_count(total: Column, size: int = V.PAGE_SIZE) -> Column:
    return F.greatest(F.ceil(total / size), F.lit(1)).cast("bigint")


# ---- text search ----------------------------------------------------------------------
def tokens(c: Column) -> Column:
    return F.filter(F.split(fold_accents(empty_if_null(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build_postings(jobs: DataFrame, fields=SEARCH_FIELDS) -> DataFrame:
    """Inverted index: token, id, field, positions. Store sorted by token for prefix pruning."""
    rows = jobs.select(
        "id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("ts")) for f in fields])).alias("f"),
    ).select("id", "f.field", F.posexplode("f.ts").alias("pos", "token"))
    return rows.groupBy("token", "id", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def write_postings(jobs: DataFrame, path: str) -> None:
    """Range-sorted by token, so that a prefix reads few row groups."""
    build_postings(jobs).repartitionByRange("token").sortWithinPartitions("token").write.mode(
        "errorifexists"
    ).parquet(path)


def prefix_hits(postings: DataFrame, q: str) -> DataFrame:
    """Ids with every query word as a prefix of a token, in any field. A word with inner
    underscores is a phrase whose last part is a prefix."""
    terms = []
    for i, word in enumerate(query_words(q)):
        parts = [p for p in fold_word(word).split("_") if p]
        if parts:
            terms.append((i, parts))
    if not terms:
        raise ValueError("the query has no words")
    single = [(i, p[0]) for i, p in terms if len(p) == 1]
    bits = None
    if single:
        # one pass over the matching tokens; a bit per word, combined before the shuffle
        cond = reduce(lambda a, b: a | b, [F.startswith("token", F.lit(p)) for _, p in single])
        mask = reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.when(F.startswith("token", F.lit(p)), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in single],
        )
        bits = postings.filter(cond).select("id", mask.alias("m"))
    for i, parts in terms:
        if len(parts) == 1:
            continue
        places = None
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            test = F.startswith("token", F.lit(part)) if last else F.col("token") == part
            here = postings.filter(test).select(
                "id", "field", F.explode(F.transform("positions", lambda p: p - k)).alias("at")
            ).distinct()
            places = here if places is None else places.join(here, ["id", "field", "at"], "left_semi")
        phrase = places.select("id").distinct().withColumn("m", F.lit(1 << i))
        bits = phrase if bits is None else bits.unionByName(phrase)
    full = sum(1 << i for i, _ in terms)
    return bits.groupBy("id").agg(F.bit_or("m").alias("m")).filter(F.col("m") == full).select("id")


def prefix_search(jobs: DataFrame, postings: DataFrame, q: str) -> DataFrame:
    """Listings that match the query; a query without words filters nothing."""
    if not query_words(q):
        return jobs
    return jobs.join(prefix_hits(postings, q), "id", "left_semi")


def like_search(jobs: DataFrame, q: str, fields=SEARCH_FIELDS) -> DataFrame:
    conds = [
        reduce(lambda a, b: a | b, [contains_ci(empty_if_null(F.col(f)), w) for f in fields])
        for w in query_words(q)
    ]
    return jobs.filter(reduce(lambda a, b: a & b, conds)) if conds else jobs


def contains_search(df: DataFrame, columns, q: str) -> DataFrame:
    if not q:
        return df
    return df.filter(reduce(lambda a, b: a | b, [contains_ci(empty_if_null(F.col(c)), q) for c in columns]))


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def alias_equals(c: Column, alias: str) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit(" "), F.lit(""))) == alias


def recent(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(column) >= as_of - F.expr(f"interval {days} days"))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values, sorted."""
    return df.select(F.col(column).alias("value")).filter(F.trim("value") != "").distinct().orderBy("value")


# ---- landing pages ----------------------------------------------------------------------
def _landing_condition(columns, category, workplace, place, terms) -> Column:
    cond = F.lit(True)
    if category:
        cond = cond & (F.col("category") == category)
    if workplace and "remote_status" in columns:
        cond = cond & ((F.col("remote_status") == workplace) | contains_ci(F.col("location"), workplace))
    if place:
        cond = cond & contains_ci(F.col("location"), place)
    if terms:
        fields = [f for f in [*SEARCH_FIELDS, "job_description", "requirements"] if f in columns]
        text = F.lower(F.concat_ws("\n", *[empty_if_null(F.col(f)) for f in fields]))
        cond = cond & reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    return F.coalesce(cond, F.lit(False))


def landing(jobs: DataFrame, as_of_date: Column, pages=V.LANDING_PAGES, size=V.PAGE_SIZE, public_only=True):
    """All landing pages in one scan: a row is tagged with the pages it belongs to, then the
    first ``size`` rows of each page are kept."""
    names = F.array_compact(
        F.array(*[F.when(_landing_condition(jobs.columns, *p[1:]), F.lit(p[0])) for p in pages])
    )
    rows = jobs.filter(active(as_of_date)).withColumn("page", F.explode(names))
    first = Window.partitionBy("page").orderBy(*order_featured())
    top = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size)
    return top.filter(is_public(top, as_of_date)) if public_only else top
