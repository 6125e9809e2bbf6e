"""Predicates and validation over listings and pages."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import quality as Q
from ..functions import vocab as V
from ..functions.text import empty_if_null, normalize_block
from ..functions.urls import safe_url
from . import adaptors as A
from . import duck as D
from .registry import query


@query(
    "active_vs_closed",
    A.with_views(A.JOBS_SQL)
    + f"SELECT id, CASE WHEN {D.CLOSED} THEN 'closed' WHEN NOT {D.CLOSED} THEN 'active' ELSE 'unknown' END AS state FROM jobs",
)
def active_vs_closed(spark, sf_dir):
    """Three-valued closed test: an unreadable date is neither open nor closed."""
    c = Q.closed(F.col("tags"), F.col("expires_at"), A.as_of_date())
    state = F.when(c, F.lit("closed")).when(~c, F.lit("active")).otherwise(F.lit("unknown"))
    return A.jobs(spark, sf_dir).select("id", state.alias("state"))


@query("closed_strict", A.with_views(A.JOBS_SQL) + f"SELECT id FROM jobs WHERE {D.CLOSED_STRICT}")
def closed_strict(spark, sf_dir):
    jobs = A.jobs(spark, sf_dir)
    return jobs.filter(Q.closed_strict(F.col("tags"), F.col("expires_at"), A.as_of_date())).select("id")


@query(
    "merged_listings",
    A.with_views(A.JOBS_SQL, *D.block_ctes("b", "jobs", "job_description"))
    + f"SELECT id, {D.merged('title', 'block')} AS merged, length(block) AS n_chars FROM b",
)
def merged_listings(spark, sf_dir):
    """Does the text of a listing look like several listings?"""
    rows = A.jobs(spark, sf_dir).select("id", "title", normalize_block(F.col("job_description")).alias("block"))
    return rows.select(
        "id", Q.is_merged(F.col("title"), F.col("block")).alias("merged"), F.length("block").cast("bigint").alias("n_chars")
    )


@query(
    "low_value_titles",
    A.with_views("head AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source FROM documents)")
    + f"SELECT id FROM head WHERE {D.low_value('title')}",
)
def low_value_titles(spark, sf_dir):
    """First lines of documents that are no usable titles."""
    docs = A.texts(spark, sf_dir, "documents")
    head = docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return head.filter(Q.low_value(F.col("title"), F.lit(""))).select("id")


_BAD_VIEW = (
    "spam AS (SELECT *, CASE WHEN id % 23 = 0 THEN text_ || chr(10) || 'Please mention the WORD pear and tag RMTUyLjU1LjE3Ny44Mw== here.' "
    "WHEN id % 29 = 0 THEN text_ || ' See this and similar jobs on LinkedIn.' WHEN id % 31 = 0 THEN text_ || ' https://remoteok.com/remote-jobs/9' ELSE text_ END AS body "
    "FROM (SELECT doc_id AS id, lang, source, text AS text_ FROM documents))"
)


def spam_rows(spark, sf_dir):
    """Documents, some with scraped boilerplate added."""
    docs = A.texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")
    body = (
        F.when(F.col("id") % 23 == 0, F.concat("text", F.lit("\nPlease mention the WORD pear and tag RMTUyLjU1LjE3Ny44Mw== here.")))
        .when(F.col("id") % 29 == 0, F.concat("text", F.lit(" See this and similar jobs on LinkedIn.")))
        .when(F.col("id") % 31 == 0, F.concat("text", F.lit(" https://remoteok.com/remote-jobs/9")))
        .otherwise(F.col("text"))
    )
    return docs.withColumn("body", body)


_REASON = D.first_of(
    [(f"contains(body, {D.q(V.BAD_MARKER)})", "'spam verification tag'")]
    + [(f"contains(lower(body), {D.q(p)})", D.q(r)) for p, r in zip(V.BAD_PHRASES, V.BAD_PHRASE_REASONS)]
    + [(f"contains(lower(body), {D.q(V.BAD_URL_FRAGMENT)})", "'remoteok job url'")]
)


@query(
    "bad_content_report",
    A.with_views(_BAD_VIEW, f"r AS (SELECT id, source, {_REASON} AS reason, substr(replace(replace(body, chr(13), ' '), chr(10), ' '), 1, 260) AS sample FROM spam)")
    + "SELECT * FROM r WHERE reason IS NOT NULL ORDER BY id DESC LIMIT 200",
)
def bad_content_report(spark, sf_dir):
    """Rows with unsafe content: reason, sample, newest 200 (the report's size)."""
    rows = spam_rows(spark, sf_dir).select(
        "id", "source", Q.bad_reason(F.col("body")).alias("reason"),
        F.substring(F.translate("body", "\r\n", "  "), 1, 260).alias("sample"),
    )
    return rows.filter("reason is not null").orderBy(F.desc("id")).limit(200)


@query(
    "bad_content_rows",
    A.with_views(_BAD_VIEW) + f"SELECT id FROM spam WHERE {D.bad_row(['source', 'body'])}",
)
def bad_content_rows(spark, sf_dir):
    rows = spam_rows(spark, sf_dir)
    return rows.filter(Q.bad_content([F.col("source"), F.col("body")], [])).select("id")


@query(
    "safe_url_filter",
    A.with_views(
        "u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'https://remoteok.com/remote-jobs/x' WHEN 2 THEN ' ' || url ELSE url END AS url FROM pages)"
    )
    + f"SELECT page_id, url FROM u WHERE {D.inline('url')} <> '' AND length({D.inline('url')}) <= 2048 AND {D.is_web(D.inline('url'))} AND NOT {D.bad_url(D.inline('url'))}",
)
def safe_url_filter(spark, sf_dir):
    k = F.col("page_id") % 5
    url = (
        F.when(k == 0, F.replace("url", F.lit("http"), F.lit("ftp")))
        .when(k == 1, F.lit("https://remoteok.com/remote-jobs/x"))
        .when(k == 2, F.concat(F.lit(" "), "url"))
        .otherwise(F.col("url"))
    )
    rows = A.texts(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return rows.filter(safe_url(F.col("url"))).select("page_id", "url")


_REMOTE = "(remote_status = 'Remote' OR contains(lower(category), 'remote') OR contains(lower(location), 'remote'))"
_FULL = "concat_ws(chr(10), location, title, summary)"


def _dword(p):
    return p.replace(r"\b", "")


def _reason_rules():
    rules = [(f"{n}_too_long", f"length(coalesce({n}, '')) > {m}") for n, m in V.RECORD_MAX_LENGTHS.items()]
    rules += [
        ("title_too_short", "length(title) < 5"),
        ("title_not_clean", "length(title) > 120 OR " + D.hit("title", r"\|\s*(apply by|deadline|closing date|earn|salary)")),
        ("title_not_real_role", f"NOT {D.is_role(D.clean('title'))}"),
        ("company_missing", "length(company) < 2"),
        ("company_not_clean", f"NOT {D.is_company(D.clean('company'))}"),
        ("summary_too_short", "length(summary) < 80"),
        ("description_missing", "block = ''"),
        ("description_too_long", "length(block) > 12000"),
        ("probable_merged_listing", D.merged("title", "block")),
        ("apply_url_invalid", f"NOT {D.is_web('apply_url')}"),
        ("source_url_invalid", f"NOT {D.is_web('source_url')}"),
        ("expired", f"coalesce(trim(coalesce(expires_at, '')) <> '' AND {D.day('expires_at')} < {D.AS_OF_DATE}, false)"),
        ("outside_allowed_locations", f"NOT {D.any_contains('lower(concat_ws(chr(32), location, title, summary))', ['zimbabwe', 'remote', 'south africa'])}"),
        (
            "remote_location_restricted",
            f"{_REMOTE} AND {D.hit(_FULL, D.BOUNDARY_L + _dword(V.REMOTE_RESTRICTED) + D.BOUNDARY_R)} AND NOT {D.hit(_FULL, D.BOUNDARY_L + _dword(V.REMOTE_ALLOWED) + D.BOUNDARY_R)}",
        ),
        ("low_quality_or_spam", D.hit("title || ' ' || summary", V.SPAM_WORDS)),
        ("marketing_landing_page", D.hit("summary", V.MARKETING_WORDS)),
        ("unsafe_scraped_content", D.bad_row(D.BAD_COLS)),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {D.q(n)} END" for n, c in rules) + "], lambda r: r IS NOT NULL)"


@query(
    "validation_reasons",
    A.with_views(A.JOBS_SQL, *D.block_ctes("b", "jobs", "coalesce(nullif(job_description, ''), summary)"), f"r AS (SELECT id, {_reason_rules()} AS reasons FROM b)")
    + "SELECT id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS ok FROM r",
)
def validation_reasons(spark, sf_dir):
    """All validation rules on every listing; the codes of the failed ones."""
    allowed = F.array(*[F.lit(x) for x in ("Zimbabwe", "Remote", "South Africa")])
    rows = A.jobs(spark, sf_dir).select(
        "id", Q.reject_reasons(A.as_of_date(), allowed, F.lit(True)).alias("reasons")
    )
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("ok"))


def _form_sql():
    rules = [(" OR ".join(f"coalesce({n}, '') = ''" for n in V.FORM_REQUIRED), "required_field_missing")]
    rules += [(f"length(coalesce({n}, '')) > {m}", f"{n}_too_long") for n, m in V.FORM_MAX_LENGTHS.items()]
    for n, allowed in (
        ("category", V.CATEGORIES), ("employment_type", V.FORM_EMPLOYMENT_TYPES),
        ("remote_status", V.FORM_REMOTE_STATUSES), ("experience_level", V.FORM_EXPERIENCE_LEVELS),
    ):
        rules.append((f"coalesce({n}, '') <> '' AND {n} NOT IN ({', '.join(D.q(a) for a in allowed)})", f"{n}_invalid"))
    rules.append((f"NOT ({D.is_web(D.inline('apply_url'))} AND NOT {D.bad_url(D.inline('apply_url'))})", "apply_url_invalid"))
    rules.append((D.bad_row(D.BAD_COLS[:-1]), "unsafe_scraped_content"))
    for n in ("expires_at", "posted_at"):
        rules.append((f"coalesce({n}, '') <> '' AND NOT regexp_matches({n}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(?:\\s+\\d{{2}}:\\d{{2}}:\\d{{2}})?$')", f"{n}_invalid"))
    return D.first_of([(f"({c})", D.q(m)) for c, m in rules])


@query("form_first_error", A.with_views(A.JOBS_SQL) + f"SELECT id, {_form_sql()} AS error FROM jobs")
def form_first_error(spark, sf_dir):
    """First failed rule of each row taken as a submitted form."""
    jobs = A.jobs(spark, sf_dir)
    return jobs.select("id", Q.form_error(jobs.columns).alias("error"))


_OFFER_SAFE = "({w} AND NOT {b})"


@query(
    "offer_validation",
    A.with_views(A.OFFERS_SQL)
    + "SELECT id, CASE WHEN " + " OR ".join(f"coalesce({n}, '') = ''" for n in V.OFFER_REQUIRED) + " THEN 'required_field_missing' "
    + f"WHEN NOT ({D.is_web('affiliate_url')} AND NOT {D.bad_url('affiliate_url')}) THEN 'affiliate_url_invalid' "
    + f"WHEN image_url <> '' AND NOT {D.is_web('image_url')} THEN 'image_url_invalid' END AS error, cast(priority_score AS bigint) AS priority_score FROM offers",
)
def offer_validation(spark, sf_dir):
    """First failed rule of each offer row, after field cleaning."""
    rows = Q.clean_offer(A.offers(spark, sf_dir))
    return rows.select(
        "id", Q.offer_error(rows.columns).alias("error"), F.col("priority_score").cast("bigint").alias("priority_score")
    )


@query(
    "valid_emails",
    A.with_views(A.USERS_SQL)
    + "SELECT id, lower(trim(email)) AS email FROM (SELECT id, CASE WHEN id % 7 = 0 THEN replace(email, '@', ' at ') ELSE email END AS email FROM users) "
    "WHERE regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')",
)
def valid_emails(spark, sf_dir):
    """Usable addresses of recipient lists (here one address per list)."""
    email = F.when(F.col("id") % 7 == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email"))
    rows = A.users(spark, sf_dir).select("id", Q.recipients(F.array(email)).alias("to"))
    return rows.select("id", F.explode("to").alias("email"))


@query(
    "aggregator_rows",
    A.with_views(A.JOBS_SQL)
    + f"SELECT id, regexp_replace(lower({D.clean('company')}), '[^a-z0-9]+', '', 'g') = 'vacancymail' AS is_alias, "
    f"({D.word('location', ['zimbabwe'])} OR contains(lower(source_name || ' ' || source_url), 'vacancymail_zimbabwe') "
    f"OR ends_with(lower({D.url_part('source_url', 2)}), 'vacancymail.co.zw')) AS in_context FROM jobs",
)
def aggregator_rows(spark, sf_dir):
    c = F.col
    return A.jobs(spark, sf_dir).select(
        "id", C.is_aggregator_name(c("company")).alias("is_alias"),
        C.in_aggregator_context(c("location"), c("source_name"), c("source_url")).alias("in_context"),
    )


_D = D.iso_day("expires_at")


@query(
    "deadline_labels",
    A.with_views(A.JOBS_SQL)
    + f"SELECT id, CASE WHEN {_D} IS NULL THEN substr(trim(coalesce(expires_at, '')), 1, 40) WHEN date_diff('day', {D.AS_OF_DATE}, {_D}) < 0 THEN 'Closed' "
    f"WHEN date_diff('day', {D.AS_OF_DATE}, {_D}) = 0 THEN 'Closes today' WHEN date_diff('day', {D.AS_OF_DATE}, {_D}) = 1 THEN 'Closes tomorrow' "
    f"WHEN date_diff('day', {D.AS_OF_DATE}, {_D}) <= 7 THEN 'Closes in ' || date_diff('day', {D.AS_OF_DATE}, {_D}) || ' days' "
    f"ELSE strftime({_D}, '%d %b %Y') END AS label FROM jobs",
)
def deadline_labels(spark, sf_dir):
    return A.jobs(spark, sf_dir).select("id", C.deadline_label(F.col("expires_at"), A.as_of_date()).alias("label"))


_S = f"date_diff('second', created_at, {D.AS_OF})"


@query(
    "age_labels",
    A.with_views(A.USERS_SQL)
    + f"SELECT id, CASE WHEN {_S} < 3600 THEN greatest(cast(floor({_S} / 60) AS bigint), 1) || 'm ago' WHEN {_S} < 86400 THEN cast(floor({_S} / 3600) AS bigint) || 'h ago' "
    f"WHEN {_S} < 30 * 86400 THEN cast(floor({_S} / 86400) AS bigint) || 'd ago' ELSE strftime(created_at, '%Y-%m-%d') END AS label, {_S} < 3 * 86400 AS is_new FROM users",
)
def age_labels(spark, sf_dir):
    ts = F.col("created_at")
    return A.users(spark, sf_dir).select(
        "id", C.age_label(ts, A.as_of()).alias("label"), C.is_new(ts, A.as_of()).alias("is_new")
    )


_UA = "(CASE event_id % 4 WHEN 0 THEN 'Mozilla (Linux; Android 14) Mobile' WHEN 1 THEN 'Mozilla (iPad; CPU OS 17)' WHEN 2 THEN 'Mozilla (X11; Linux)' END)"


@query(
    "device_classes",
    f"WITH u AS (SELECT event_id, lower(coalesce({_UA}, '')) AS ua FROM events) SELECT CASE WHEN regexp_matches(ua, 'mobile|android|iphone') THEN 'mobile' "
    "WHEN regexp_matches(ua, 'ipad|tablet') THEN 'tablet' ELSE 'desktop' END AS device, count(*) AS n FROM u GROUP BY 1",
)
def device_classes(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(C.device(F.expr(_UA)).alias("device"))
    return rows.groupBy("device").agg(F.count("*").alias("n"))
