"""Published outputs."""

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import email_key
from ..functions.urls import redact_url
from ..operators import publish as P
from . import adaptors as A
from . import duck as D
from .registry import query


def _documents_sql():
    remote = "(lower(location) NOT LIKE '%hybrid%' AND remote_status <> 'Hybrid' AND (remote_status = 'Remote' OR regexp_matches(lower(location), 'remote')))"
    posted = "coalesce(posted_at, strftime(created_at, '%Y-%m-%d'))"
    country = "CASE WHEN contains(location, 'Zimbabwe') THEN 'ZW' WHEN contains(location, 'South Africa') THEN 'ZA' WHEN contains(location, 'Bulawayo') THEN 'ZW' END"
    locality = "CASE WHEN location LIKE 'Harare%' THEN 'Harare' WHEN location LIKE 'Hybrid%' THEN 'South Africa' ELSE regexp_replace(location, '^Remote / ', '') END"
    area = "CASE WHEN regexp_matches(lower(location), 'zimbabwe|harare|bulawayo') THEN 'Zimbabwe' WHEN contains(lower(location), 'africa') THEN 'Africa' END"
    cur = "CASE WHEN salary_range LIKE 'USD%' THEN 'USD' WHEN salary_range LIKE 'EUR%' THEN 'EUR' END"
    code = D.first_of([(f"lower(employment_type) = {D.q(k)}", D.q(v)) for k, v in V.PUBLISHED_EMPLOYMENT_CODES.items()], "''")
    return A.with_views(A.JOBS_SQL, f"p AS (SELECT *, {remote} AS remote FROM jobs WHERE NOT {D.CLOSED_STRICT})") + (
        f"SELECT id, title, {posted} AS date_posted, strftime({D.iso_day('expires_at')}, '%Y-%m-%d') AS valid_through, company, coalesce(external_job_id, cast(id AS varchar)) AS identifier, "
        f"{code} AS codes, {cur} AS currency, remote, CASE WHEN remote THEN {area} END AS area, CASE WHEN NOT remote THEN {country} END AS country, CASE WHEN NOT remote THEN {locality} END AS locality FROM p"
    )


@query("posting_columns", _documents_sql())
def posting_columns(spark, sf_dir):
    """Parts of the posting document of every open listing."""
    rows = P.posting_columns(A.jobs(spark, sf_dir), A.as_of_date())
    r = F.col("remote")
    return rows.select(
        "id", "title", "date_posted", "valid_through", "company", "identifier", F.array_join("employment_codes", ",").alias("codes"),
        F.col("salary.currency").alias("currency"), "remote", F.when(r, F.col("applicant_area.name")).alias("area"),
        F.when(~r, F.col("country")).alias("country"), F.when(~r, F.col("locality")).alias("locality"),
    )


@query("posting_documents")
def posting_documents(spark, sf_dir):
    """JobPosting JSON of every open listing."""
    return P.posting_documents(A.jobs(spark, sf_dir), A.as_of_date(), A.SITE)


def _sitemap_sql():
    fixed = [("/", "daily", "1.0"), ("/services", "monthly", "0.5"), ("/post", "monthly", "0.6")]
    fixed += [(f"/jobs/{p[0]}/", "daily", "0.8") for p in V.LANDING_PAGES] + [(f"/resources/{p}", "monthly", "0.4") for p in V.RESOURCE_PAGES]
    rows = ", ".join(f"('{A.SITE}{p}', NULL, '{c}', '{r}')" for p, c, r in fixed)
    return A.with_views(A.JOBS_SQL, *D.public_ctes("jobs"), f"f(loc, lastmod, changefreq, priority) AS (VALUES {rows})") + (
        f"SELECT * FROM f UNION ALL SELECT '{A.SITE}/job/' || id || '/' || {D.slug('title')}, coalesce(posted_at, strftime(created_at, '%Y-%m-%d')), 'weekly', '0.7' FROM pub WHERE is_public AND {D.ACTIVE}"
    )


@query("sitemap_rows", _sitemap_sql())
def sitemap_rows(spark, sf_dir):
    return P.sitemap(A.jobs(spark, sf_dir), A.as_of_date(), A.SITE)


@query(
    "feed_rows",
    A.with_views(
        A.JOBS_SQL, f"newest AS (SELECT * FROM jobs WHERE {D.ACTIVE} ORDER BY created_at DESC, id DESC LIMIT 30)", *D.public_ctes("newest"),
        *D.block_ctes("s", "(SELECT * FROM pub WHERE is_public)", "summary"),
    )
    + f"SELECT id, title || ' — ' || company AS title, '{A.SITE}/job/' || id || '/' || {D.slug('title')} AS link, md5({D.cut_at_word('block', 12000)}) AS description FROM s",
)
def feed_rows(spark, sf_dir):
    """Feed of the newest thirty open listings, then the public test."""
    rows = P.feed(A.jobs(spark, sf_dir), A.as_of_date(), A.SITE)
    return rows.select("id", "title", "link", F.md5("description").alias("description"))


@query(
    "tracking_links",
    A.with_views(A.OFFERS_SQL)
    + "SELECT id, affiliate_url || CASE WHEN contains(affiliate_url, 'utm_source=') THEN '' ELSE '?utm_source=job_board' END || '&utm_medium=affiliate&utm_campaign=' || offer_category || '&utm_content=job_detail' "
    "|| CASE WHEN tracking_id IS NOT NULL THEN '&tracking_id=' || url_encode(tracking_id) ELSE '' END AS url FROM offers",
)
def tracking_links(spark, sf_dir):
    c = F.col
    return A.offers(spark, sf_dir).select(
        "id", P.tracking_url(c("affiliate_url"), c("offer_category"), F.lit("job_detail"), c("tracking_id")).alias("url")
    )


@query("email_keys", A.with_views(A.USERS_SQL) + "SELECT id, substr(sha256(lower(email)), 1, 12) AS email_key FROM users")
def email_keys(spark, sf_dir):
    return A.users(spark, sf_dir).select("id", email_key(F.col("email")).alias("email_key"))


@query(
    "redacted_urls",
    "WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages) SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'session_id=%5Bredacted%5D&k=' || repeat('a', 200) || '...%5Btruncated%5D' AS url FROM u",
)
def redacted_urls(spark, sf_dir):
    """URLs for logs: sensitive values hidden, long ones cut."""
    bare = F.regexp_replace("url", "#.*$", "")
    join = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    url = F.concat(bare, join, F.lit("session_id=s3cret&k="), F.repeat(F.lit("a"), F.lit(300)), F.lit("#frag"))
    return A.texts(spark, sf_dir, "pages").select("page_id", redact_url(url).alias("url"))
