"""Search pages, facets, text search, landing pages."""

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.quality import is_public
from ..functions.text import empty_if_null
from ..operators import search as S
from . import adaptors as A
from . import duck as D
from .registry import query

_TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


def _created(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


LIST_COLUMNS = ["id", "title", "company", "location", "category", "featured", "created_at", "expires_at"]
_LIST_SQL = f"id, title, company, location, category, featured, {_TS}, expires_at"


@query(
    "search_filter_page",
    A.with_views(A.JOBS_SQL)
    + f"SELECT {_LIST_SQL} FROM jobs WHERE {D.ACTIVE} AND employment_type = 'Full-time' AND contains(lower(location), 'harare') "
    "ORDER BY featured DESC, jobs.created_at DESC, id DESC LIMIT 20",
)
def search_filter_page(spark, sf_dir):
    """First result page of an open-listings search with conditions, featured first."""
    jobs = A.jobs(spark, sf_dir)
    rows = S.search_page(jobs, A.as_of_date(), public_only=False, employment="Full-time", place="harare")
    return _created(rows.select(*LIST_COLUMNS))


@query(
    "search_page_newest",
    A.with_views(A.JOBS_SQL)
    + f"SELECT {_LIST_SQL} FROM jobs WHERE {D.ACTIVE} AND category = 'Government' AND remote_status = 'Hybrid' "
    "ORDER BY jobs.created_at DESC, id DESC LIMIT 20 OFFSET 20",
)
def search_page_newest(spark, sf_dir):
    """Second page, newest first."""
    rows = S.search_page(
        A.jobs(spark, sf_dir), A.as_of_date(), "newest", 2, public_only=False,
        category="Government", workplace="Hybrid",
    )
    return _created(rows.select(*LIST_COLUMNS))


@query(
    "search_page_public",
    A.with_views(
        A.JOBS_SQL,
        f"page AS (SELECT * FROM jobs WHERE {D.ACTIVE} AND experience_level = 'Senior' ORDER BY featured DESC, created_at DESC, id DESC LIMIT 20)",
        *D.public_ctes("page"),
    )
    + f"SELECT {_LIST_SQL} FROM pub WHERE is_public",
)
def search_page_public(spark, sf_dir):
    """A result page whose rows pass the public test after the limit."""
    rows = S.search_page(A.jobs(spark, sf_dir), A.as_of_date(), level="Senior")
    return _created(rows.select(*LIST_COLUMNS))


@query(
    "search_total",
    A.with_views(A.JOBS_SQL)
    + f"SELECT count(*) AS total, greatest(cast(ceil(count(*) / 20.0) AS bigint), 1) AS pages FROM jobs WHERE {D.ACTIVE} AND employment_type = 'Contract'",
)
def search_total(spark, sf_dir):
    rows = S.search_filter(A.jobs(spark, sf_dir), A.as_of_date(), employment="Contract")
    return rows.agg(F.count("*").alias("total")).select("total", S.page_count(F.col("total")).alias("pages"))


@query(
    "facet_values",
    A.with_views(A.JOBS_SQL)
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM jobs WHERE trim({c}) <> ''"
        for c in ("employment_type", "remote_status", "experience_level")
    ),
)
def facet_values(spark, sf_dir):
    jobs = A.jobs(spark, sf_dir)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"))
            for c in ("employment_type", "remote_status", "experience_level")
        ]
    )
    rows = jobs.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
    return rows.filter(F.trim("value") != "").distinct().orderBy("facet", "value")


@query(
    "deadline_order",
    A.with_views(A.JOBS_SQL)
    + f"SELECT {_LIST_SQL} FROM jobs WHERE {D.ACTIVE} "
    "ORDER BY (expires_at IS NULL OR trim(expires_at) = ''), expires_at NULLS FIRST, jobs.created_at DESC, id DESC LIMIT 20",
)
def deadline_order(spark, sf_dir):
    rows = S.search_page(A.jobs(spark, sf_dir), A.as_of_date(), "deadline", public_only=False)
    return _created(rows.select(*LIST_COLUMNS))


def _token_list(c):
    """DuckDB: accent-folded tokens of a text."""
    folded = f"translate(lower(coalesce({c}, '')), {D.q(S.ACCENTED.lower())}, {D.q(S.UNACCENTED.lower())})"
    return "list_filter(regexp_split_to_array(" + folded + ", '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _prefix_sql(prefixes):
    toks = "list_concat(" + ", ".join(_token_list(f) for f in S.SEARCH_FIELDS) + ")"
    conds = " AND ".join(f"len(list_filter(toks, lambda t: starts_with(t, {D.q(p)}))) > 0" for p in prefixes)
    return A.with_views(A.JOBS_SQL, f"tk AS (SELECT *, {toks} AS toks FROM jobs)") + f"SELECT id, title FROM tk WHERE {conds}"


@query("prefix_search", _prefix_sql(["engin", "the", "han"]))
def prefix_search(spark, sf_dir):
    """Every query word is a prefix of some token of title, company, summary or location."""
    jobs = A.jobs(spark, sf_dir)
    return S.prefix_search(jobs, S.build_postings(jobs), "Engin thé han").select("id", "title")


@query(
    "prefix_phrase_search",
    A.with_views(A.JOBS_SQL)
    + "SELECT id, title FROM jobs WHERE "
    + "regexp_matches(' ' || lower(title) || ' ', '[^a-z0-9]finance[^a-z0-9]+mana') ",
)
def prefix_phrase_search(spark, sf_dir):
    """A word with an inner underscore is a phrase of neighbouring tokens."""
    jobs = A.jobs(spark, sf_dir)
    return S.prefix_search(jobs, S.build_postings(jobs), "finance_mana").select("id", "title")


@query(
    "like_search",
    A.with_views(A.JOBS_SQL)
    + "SELECT id, title FROM jobs WHERE "
    + " AND ".join(
        "(" + " OR ".join(f"contains(lower(coalesce({f}, '')), {D.q(t)})" for f in S.SEARCH_FIELDS) + ")"
        for t in ("nurse", "firm", "ing")
    ),
)
def like_search(spark, sf_dir):
    return S.like_search(A.jobs(spark, sf_dir), "nurse Firm ing").select("id", "title")


def _landing_sql():
    parts = []
    for name, category, workplace, place, terms in V.LANDING_PAGES:
        conds = [D.ACTIVE]
        if category:
            conds.append(f"category = {D.q(category)}")
        if workplace:
            conds.append(f"(remote_status = {D.q(workplace)} OR contains(lower(location), {D.q(workplace.lower())}))")
        if place:
            conds.append(f"contains(lower(location), {D.q(place.lower())})")
        if terms:
            fields = [*S.SEARCH_FIELDS, "job_description", "requirements"]
            conds.append("(" + " OR ".join(f"contains(lower(coalesce({f}, '')), {D.q(t)})" for t in terms for f in fields) + ")")
        parts.append(f"SELECT {D.q(name)} AS page, * FROM jobs WHERE {' AND '.join(conds)}")
    return " UNION ALL ".join(parts)


@query(
    "landing_pages",
    A.with_views(
        A.JOBS_SQL,
        f"tagged AS ({_landing_sql()})",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY featured DESC, created_at DESC, id DESC) AS rank FROM tagged)",
        "top AS (SELECT * FROM ranked WHERE rank <= 20)",
        *D.public_ctes("top"),
    )
    + "SELECT page, rank, id, title FROM pub WHERE is_public",
)
def landing_pages(spark, sf_dir):
    rows = S.landing(A.jobs(spark, sf_dir), A.as_of_date())
    return rows.select("page", F.col("rank").cast("bigint").alias("rank"), "id", "title")


@query(
    "contains_search",
    A.with_views(A.JOBS_SQL)
    + "SELECT id, title, company FROM jobs WHERE contains(lower(title), 'officer') OR contains(lower(company), 'officer')",
)
def contains_search(spark, sf_dir):
    return S.contains_search(A.jobs(spark, sf_dir), ["title", "company"], "Officer").select("id", "title", "company")


@query("lookup_by_id", A.with_views(A.JOBS_SQL) + "SELECT id, title, company FROM jobs WHERE id = 17")
def lookup_by_id(spark, sf_dir):
    return S.by_id(A.jobs(spark, sf_dir), 17).select("id", "title", "company")


@query(
    "active_offer_semi",
    A.with_views(A.OFFERS_SQL, A.EVENTS_SQL)
    + "SELECT id, offer_id, event_type FROM ev WHERE offer_id IN (SELECT id FROM offers WHERE is_active)",
)
def active_offer_semi(spark, sf_dir):
    """Events of active offers only."""
    live = A.offers(spark, sf_dir).filter("is_active").select(F.col("id").alias("offer_id"))
    return A.events(spark, sf_dir).join(live, "offer_id", "left_semi").select("id", "offer_id", "event_type")


@query(
    "alias_rows",
    A.with_views(A.JOBS_SQL) + "SELECT id, company FROM jobs WHERE lower(replace(trim(company), ' ', '')) = 'vacancymail'",
)
def alias_rows(spark, sf_dir):
    jobs = A.jobs(spark, sf_dir)
    return jobs.filter(S.alias_equals(F.col("company"), V.AGGREGATOR_ALIAS)).select("id", "company")


@query(
    "recent_listings",
    A.with_views(A.USERS_SQL) + f"SELECT id, email FROM users WHERE created_at >= {D.AS_OF} - INTERVAL 7 DAY",
)
def recent_listings(spark, sf_dir):
    """Accounts made in the last seven days."""
    return S.recent(A.users(spark, sf_dir), "created_at", A.as_of(), 7).select("id", "email")


@query(
    "active_users",
    A.with_views(A.USERS_SQL, A.SAVED_SQL)
    + "SELECT id, email FROM users u WHERE is_active AND EXISTS (SELECT 1 FROM saved s WHERE s.user_id = u.id)",
)
def active_users(spark, sf_dir):
    """Active users who have a bookmark (existence test as a semi join)."""
    marked = A.saved(spark, sf_dir).select(F.col("user_id").alias("id"))
    return A.users(spark, sf_dir).filter("is_active").join(marked, "id", "left_semi").select("id", "email")


@query(
    "haystack_hits",
    A.with_views(
        A.JOBS_SQL,
        "hay AS (SELECT id, coalesce(job_description, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(requirements, '') || chr(10) || coalesce(apply_url, '') AS haystack FROM jobs)",
    )
    + "SELECT id, length(haystack) AS n_chars FROM hay WHERE contains(lower(haystack), 'remote') AND contains(lower(haystack), 'src1')",
)
def haystack_hits(spark, sf_dir):
    """Search over several columns joined in a sub-select."""
    parts = [empty_if_null(F.col(c)) for c in ("job_description", "summary", "requirements", "apply_url")]
    hay = A.jobs(spark, sf_dir).select("id", F.concat_ws("\n", *parts).alias("haystack"))
    low = F.lower("haystack")
    return hay.filter(F.contains(low, F.lit("remote")) & F.contains(low, F.lit("src1"))).select(
        "id", F.length("haystack").cast("bigint").alias("n_chars")
    )


@query(
    "public_listings",
    A.with_views(A.JOBS_SQL, *D.public_ctes("jobs")) + "SELECT id FROM pub WHERE is_public",
)
def public_listings(spark, sf_dir):
    jobs = A.jobs(spark, sf_dir)
    return jobs.filter(is_public(jobs, A.as_of_date())).select("id")
