"""Merges, deletes, updates and change feeds."""

from pyspark.sql import functions as F

from .. import schema
from ..functions import vocab as V
from ..functions.text import slug
from ..functions.urls import job_path, public_url
from ..operators import changes as C
from ..operators import merge as M
from ..session import cut_lineage, fresh_path
from ..sources import tables as T
from . import adaptors as A
from . import duck as D
from .identity_queries import hashed_jobs, incoming_jobs
from .ingest import backfill_company
from .registry import query


def _columns(df):
    return [c for c in V.MERGE_COLUMNS if c in df.columns]


@query("merge_actions")
def merge_actions(spark, sf_dir):
    """What a batch upsert does to each incoming record."""
    rows = M.merge_actions(hashed_jobs(spark, sf_dir), incoming_jobs(spark, sf_dir), "ord")
    return rows.select("ord", "stored_id", "action")


@query("merged_snapshot")
def merged_snapshot(spark, sf_dir):
    """The listings table after the upsert."""
    snapshot, _ = M.merge_jobs(hashed_jobs(spark, sf_dir), incoming_jobs(spark, sf_dir), "ord")
    return snapshot.select("id", "title", "company", "source_url", F.sha2("summary", 256).alias("summary"))


@query("merge_counts")
def merge_counts(spark, sf_dir):
    return M.action_counts(M.merge_actions(hashed_jobs(spark, sf_dir), incoming_jobs(spark, sf_dir), "ord"))


_INC = (
    "inc AS (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN summary || ' Updated.' ELSE summary END AS summary, CASE WHEN id % 10 = 0 THEN title || ' New' ELSE title END AS title, "
    "CASE WHEN id % 10 = 0 THEN NULL ELSE external_job_id END AS external_job_id, CASE WHEN id % 10 = 0 THEN source_url || '/v2' ELSE source_url END AS source_url, "
    "CASE WHEN id % 10 = 0 THEN apply_url || '/v2' ELSE apply_url END AS apply_url) FROM jobs)"
)
_CMP = [c for c in V.MERGE_COLUMNS if c not in ("content_hash",)]
_DIFF = "list_filter([" + ", ".join(
    f"CASE WHEN i.{c} IS NOT NULL AND trim(coalesce(i.{c}, '')) <> trim(coalesce(j.{c}, '')) THEN {D.q(c)} END" for c in _CMP
) + "], lambda x: x IS NOT NULL)"


@query(
    "material_changes",
    A.with_views(A.JOBS_SQL, _INC, f"d AS (SELECT j.id, {_DIFF} AS cols FROM jobs j JOIN inc i ON i.id = j.id)")
    + "SELECT id, array_to_string(cols, ',') AS changed FROM d WHERE len(cols) > 0",
)
def material_changes(spark, sf_dir):
    """Columns in which an incoming record differs from the stored one."""
    cur = A.jobs(spark, sf_dir)
    inc = incoming_jobs(spark, sf_dir).withColumnRenamed("ord", "id").drop("content_hash")
    both = cur.alias("j").join(inc.alias("i"), "id")
    cols = M.changed_columns(_CMP, lambda c: F.col(f"j.{c}"), lambda c: F.col(f"i.{c}"))
    return both.select("id", F.array_join(cols, ",").alias("changed")).filter("changed <> ''")


@query(
    "overlay_update",
    A.with_views(A.JOBS_SQL, _INC)
    + "SELECT j.id, coalesce(i.title, j.title) AS title, coalesce(i.external_job_id, j.external_job_id) AS external_job_id, coalesce(i.source_url, j.source_url) AS source_url, "
    "md5(coalesce(i.summary, j.summary)) AS summary FROM jobs j LEFT JOIN inc i ON i.id = j.id",
)
def overlay_update(spark, sf_dir):
    """Non-null values over stored rows; a null never erases."""
    inc = incoming_jobs(spark, sf_dir).withColumn("stored_id", F.col("ord"))
    rows = M.overlay(A.jobs(spark, sf_dir), inc, "ord", _CMP)
    return rows.select("id", "title", "external_job_id", "source_url", F.md5("summary").alias("summary"))


@query(
    "surrogate_ids",
    A.with_views(A.JOBS_SQL)
    + "SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY id) AS id, id AS ord FROM jobs",
)
def surrogate_ids(spark, sf_dir):
    """Ids for inserted rows, in their order, after the largest stored id."""
    jobs = A.jobs(spark, sf_dir)
    new = jobs.select(F.col("id").alias("ord"))
    return M.assign_ids(jobs, new, "ord").select("id", "ord")


_EXPIRED = f"coalesce(trim(coalesce(expires_at, '')) <> '' AND {D.day('expires_at')} < {D.AS_OF_DATE}, false)"


def _url_sql(id_="id", title="title"):
    return f"'{A.SITE}/job/' || {id_} || '/' || {D.slug(title)}"


@query("expired_delete", A.with_views(A.JOBS_SQL) + f"SELECT id, {_url_sql()} AS url FROM jobs WHERE {_EXPIRED}")
def expired_delete(spark, sf_dir):
    """Expired rows with the public URLs to withdraw."""
    _, gone = M.delete_expired(A.jobs(spark, sf_dir), A.as_of_date())
    return gone.select("id", public_url(job_path(F.col("id"), F.col("title"), slug), A.SITE).alias("url"))


@query("purge_closed", A.with_views(A.JOBS_SQL) + f"SELECT id FROM jobs WHERE NOT coalesce({D.CLOSED}, false)")
def purge_closed(spark, sf_dir):
    """Rows left after closed ones were purged; undecided ones stay."""
    left, _ = M.purge_closed(A.jobs(spark, sf_dir), A.as_of_date())
    return left.select("id")


_SPAMMY = (
    "sj AS (SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN summary || ' Companies can search these words.' ELSE summary END AS summary, "
    "CASE WHEN id % 31 = 0 THEN 'https://RemoteOK.com/remote-jobs/' || id ELSE apply_url END AS apply_url) FROM jobs)"
)
_STORED_BAD = (
    "(" + D.BAD.replace("{t}", "concat_ws(chr(10), coalesce(summary, ''), coalesce(job_description, ''), coalesce(requirements, ''))")
    + " OR " + " OR ".join(f"starts_with(lower(coalesce({u}, '')), {D.q(p)})" for u in ("apply_url", "source_url") for p in V.BAD_URL_PREFIXES) + ")"
)


def spammy_jobs(spark, sf_dir):
    k = F.col("id")
    return A.jobs(spark, sf_dir).withColumns(
        {
            "summary": F.when(k % 23 == 0, F.concat("summary", F.lit(" Companies can search these words."))).otherwise(F.col("summary")),
            "apply_url": F.when(k % 31 == 0, F.concat(F.lit("https://RemoteOK.com/remote-jobs/"), k.cast("string"))).otherwise(F.col("apply_url")),
        }
    )


@query(
    "bad_delete_cascade",
    A.with_views(A.JOBS_SQL, A.SAVED_SQL, _SPAMMY)
    + f"SELECT user_id, job_id FROM saved WHERE job_id NOT IN (SELECT id FROM sj WHERE {_STORED_BAD})",
)
def bad_delete_cascade(spark, sf_dir):
    """Bookmarks left after listings with unsafe content went."""
    _, gone = M.delete_bad(spammy_jobs(spark, sf_dir))
    return M.cascade(A.saved(spark, sf_dir), gone, "job_id").select("user_id", "job_id")


@query(
    "maintenance_counters",
    A.with_views(A.JOBS_SQL, _SPAMMY, f"w AS (SELECT CASE WHEN {_EXPIRED} THEN 'e' WHEN {_STORED_BAD} THEN 'b' ELSE 'k' END AS w FROM sj)")
    + "SELECT count(*) FILTER (WHERE w = 'e') AS expired_jobs, count(*) FILTER (WHERE w = 'b') AS bad_description_jobs, count(*) FILTER (WHERE w <> 'k') AS deleted, count(*) FILTER (WHERE w = 'k') AS total_jobs FROM w",
)
def maintenance_counters(spark, sf_dir):
    _, _, counters = M.clean_jobs(spammy_jobs(spark, sf_dir), A.saved(spark, sf_dir), A.as_of_date())
    return counters


@query(
    "alert_upsert",
    A.with_views(
        A.ALERTS_SQL, A.SIGNUPS_SQL,
        "g AS (SELECT email, category, location, arg_max(source, ord) AS s, arg_max(frequency, ord) AS f, arg_min(unsubscribe_token, ord) AS t FROM signups GROUP BY ALL)",
    )
    + "SELECT email, category, location, CASE WHEN g.s IS NOT NULL THEN g.s ELSE a.source END AS source, CASE WHEN g.s IS NOT NULL THEN g.f ELSE a.frequency END AS frequency, "
    "(g.s IS NOT NULL OR coalesce(a.active, false)) AS active, coalesce(a.unsubscribe_token, g.t) AS unsubscribe_token, CASE WHEN g.s IS NULL THEN a.unsubscribed_at END AS unsubscribed_at, "
    "CASE WHEN g.s IS NOT NULL THEN '2024-07-01' ELSE a.updated_at END AS updated_at FROM alerts a FULL OUTER JOIN g USING (email, category, location)",
)
def alert_upsert(spark, sf_dir):
    return M.upsert_alerts(A.alerts(spark, sf_dir), A.signups(spark, sf_dir), "ord", F.lit(A.AS_OF_DATE))


@query(
    "alert_unsubscribe",
    A.with_views(A.ALERTS_SQL, "used AS (SELECT DISTINCT 'token-of-alert-number-' || o_custkey AS t FROM orders WHERE o_orderstatus = 'P')")
    + "SELECT email, category, CASE WHEN active AND t IS NOT NULL THEN false ELSE active END AS active, CASE WHEN active AND t IS NOT NULL THEN '2024-07-01' ELSE unsubscribed_at END AS unsubscribed_at "
    "FROM alerts LEFT JOIN used ON t = unsubscribe_token",
)
def alert_unsubscribe(spark, sf_dir):
    used = A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("token-of-alert-number-"), F.col("o_custkey").cast("string")).alias("unsubscribe_token")
    )
    rows = M.unsubscribe(A.alerts(spark, sf_dir), used, F.lit(A.AS_OF_DATE))
    return rows.select("email", "category", "active", "unsubscribed_at")


@query(
    "alert_tokens",
    A.with_views(A.ALERTS_SQL)
    + "SELECT email, coalesce(nullif(unsubscribe_token, ''), sha256(email || '|' || category || '|' || location || '|salt')) AS unsubscribe_token FROM alerts",
)
def alert_tokens(spark, sf_dir):
    return M.fill_tokens(A.alerts(spark, sf_dir), "salt").select("email", "unsubscribe_token")


_MARKS = (
    "marks AS (SELECT o_custkey AS user_id, o_orderkey % 400 AS job_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P')"
)


def new_marks(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 400).alias("job_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query(
    "bookmark_insert_ignore",
    A.with_views(A.JOBS_SQL, A.SAVED_SQL, _MARKS)
    + "SELECT user_id, job_id, strftime(created_at, '%Y-%m-%d') AS day FROM saved UNION ALL SELECT user_id, job_id, strftime(min(created_at), '%Y-%m-%d') FROM marks m "
    "WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = m.user_id AND s.job_id = m.job_id) AND job_id IN (SELECT id FROM jobs) GROUP BY user_id, job_id",
)
def bookmark_insert_ignore(spark, sf_dir):
    rows = M.save_jobs(A.saved(spark, sf_dir), new_marks(spark, sf_dir), A.jobs(spark, sf_dir))
    return rows.select("user_id", "job_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    "bookmark_remove",
    A.with_views(A.SAVED_SQL)
    + "SELECT user_id, job_id FROM saved WHERE (user_id, job_id) NOT IN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def bookmark_remove(spark, sf_dir):
    keys = A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("job_id")
    )
    return M.unsave(A.saved(spark, sf_dir), keys).select("user_id", "job_id")


@query(
    "flag_toggle",
    A.with_views(A.JOBS_SQL, "t AS (SELECT o_orderkey % 500 AS id, count(*) % 2 = 1 AS flip FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)")
    + "SELECT j.id, CASE WHEN coalesce(t.flip, false) THEN NOT featured ELSE featured END AS featured FROM jobs j LEFT JOIN t ON t.id = j.id",
)
def flag_toggle(spark, sf_dir):
    ids = A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select((F.col("o_orderkey") % 500).alias("id"))
    return M.toggle(A.jobs(spark, sf_dir), ids, "featured").select("id", "featured")


@query(
    "row_edits",
    A.with_views(
        A.JOBS_SQL,
        "e AS (SELECT o_orderkey % 1200 AS id, arg_max('Edit ' || o_orderkey, o_orderkey) AS title, arg_max(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END, o_orderkey) AS company, arg_max(o_orderkey, o_orderkey) AS k, "
        "max(o_orderkey) AS mk FROM orders GROUP BY 1)",
        "f AS (SELECT e.id, e.title, CASE WHEN o.o_orderstatus = 'F' THEN NULL ELSE o.o_orderpriority END AS company FROM e JOIN orders o ON o.o_orderkey = e.mk)",
    )
    + "SELECT coalesce(j.id, f.id) AS id, CASE WHEN f.id IS NOT NULL THEN f.title ELSE j.title END AS title, CASE WHEN f.id IS NOT NULL THEN f.company ELSE j.company END AS company, j.location FROM jobs j FULL OUTER JOIN f ON f.id = j.id",
)
def row_edits(spark, sf_dir):
    """Full-row edits, the last one per row wins; unknown ids are added."""
    edits = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 1200).alias("id"),
        F.concat(F.lit("Edit "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("company"),
    )
    return M.apply_edits(A.jobs(spark, sf_dir), edits, "ord").select("id", "title", "company", "location")


_MAT = lambda a, b: " OR ".join(f"trim(coalesce(cast({a}.{c} AS varchar), '')) <> trim(coalesce(cast({b}.{c} AS varchar), ''))" for c in V.PUBLISH_COLUMNS)


@query(
    "snapshot_diff",
    A.with_views(A.JOBS_SQL, A.JOBS_AFTER_SQL)
    + f"SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'delete' WHEN {_MAT('a', 'b')} THEN 'update' ELSE 'same' END AS change FROM jobs b FULL OUTER JOIN jobs_after a ON a.id = b.id",
)
def snapshot_diff(spark, sf_dir):
    return C.diff(A.jobs(spark, sf_dir), A.jobs_after(spark, sf_dir))


_VIS_AFTER = "jv AS (SELECT * REPLACE (CASE WHEN id % 4 = 1 THEN tags || ',closed' ELSE tags END AS tags) FROM jobs_after)"


@query(
    "visibility_changes",
    A.with_views(A.JOBS_SQL, A.JOBS_AFTER_SQL, _VIS_AFTER, *D.public_ctes("jobs", "pb"), *D.public_ctes("jv", "pa"))
    + f"SELECT * FROM (SELECT coalesce(b.id, a.id) AS id, CASE WHEN coalesce(b.is_public, false) AND a.id IS NOT NULL AND NOT a.is_public THEN 'hidden' "
    f"WHEN coalesce(a.is_public, false) AND b.id IS NULL THEN 'published' WHEN coalesce(a.is_public, false) AND ({_MAT('a', 'b')}) THEN 'changed' END AS event FROM pb b FULL OUTER JOIN pa a ON a.id = b.id) WHERE event IS NOT NULL",
)
def visibility_changes(spark, sf_dir):
    """Listings to announce after a change: hidden, published, changed."""
    after = A.jobs_after(spark, sf_dir).withColumn(
        "tags", F.when(F.col("id") % 4 == 1, F.concat("tags", F.lit(",closed"))).otherwise(F.col("tags"))
    )
    return C.visibility(A.jobs(spark, sf_dir), after, A.as_of_date()).select("id", "event")


_RAW_URLS = (
    "raw AS (SELECT id AS pos, CASE id % 6 WHEN 0 THEN '/admin/' || id WHEN 1 THEN '/job/' || (id - id % 3) WHEN 2 THEN 'https://other.example.org/job/' || id WHEN 3 THEN 'https://listings.example.com/job/' || id || '?x=1' "
    "WHEN 4 THEN 'job/' || id ELSE 'https://LISTINGS.example.com/job/' || (id - id % 3) END AS url FROM jobs)"
)


@query(
    "url_batches",
    A.with_views(
        A.JOBS_SQL, _RAW_URLS,
        f"ok AS (SELECT pos, '{A.SITE}' || CASE WHEN starts_with(url, '/') THEN url WHEN starts_with(url, 'job/') THEN '/' || url ELSE {D.url_part('url', 3)} END AS url FROM raw WHERE pos % 6 NOT IN (0, 2, 3))",
        "f AS (SELECT url, min(pos) AS pos FROM ok GROUP BY url)", "n AS (SELECT url, row_number() OVER (ORDER BY pos) AS n FROM f)",
    )
    + "SELECT url, n, (n - 1) // 100 AS batch, (SELECT count(*) FROM f) = 1 AS single FROM n",
)
def url_batches(spark, sf_dir):
    """Publishable URLs, each once, in batches of a hundred."""
    k = F.col("id")
    base = (k - k % 3).cast("string")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("/admin/"), k.cast("string")))
        .when(k % 6 == 1, F.concat(F.lit("/job/"), base))
        .when(k % 6 == 2, F.concat(F.lit("https://other.example.org/job/"), k.cast("string")))
        .when(k % 6 == 3, F.concat(F.lit("https://listings.example.com/job/"), k.cast("string"), F.lit("?x=1")))
        .when(k % 6 == 4, F.concat(F.lit("job/"), k.cast("string")))
        .otherwise(F.concat(F.lit("https://LISTINGS.example.com/job/"), base))
    )
    raw = A.jobs(spark, sf_dir).select(k.alias("pos"), url.alias("url"))
    return C.url_batches(raw, "url", "pos", A.SITE, 100)


@query(
    "changed_url_feed",
    A.with_views(A.JOBS_SQL, _INC)
    + f"SELECT DISTINCT {_url_sql('i.id', 'i.title')} AS url FROM jobs j JOIN inc i ON i.id = j.id WHERE " + " OR ".join(
        f"(i.{c} IS NOT NULL AND trim(coalesce(i.{c}, '')) <> trim(coalesce(j.{c}, '')))" for c in _CMP
    ),
)
def changed_url_feed(spark, sf_dir):
    """Public URLs of records that a merge changed."""
    cur = A.jobs(spark, sf_dir)
    inc = incoming_jobs(spark, sf_dir).withColumnRenamed("ord", "id").drop("content_hash")
    both = cur.alias("j").join(inc.alias("i"), "id")
    differs = M.material_change(_CMP, lambda c: F.col(f"j.{c}"), lambda c: F.col(f"i.{c}"))
    actions = both.select("id", F.col("i.title").alias("title"), F.when(differs, "updated").otherwise("skipped").alias("action"))
    return M.changed_urls(actions, A.SITE)


@query("company_backfill")
def company_backfill(spark, sf_dir):
    """Repair of listings that name only the aggregator."""
    jobs = A.jobs(spark, sf_dir).withColumn("content_hash", F.lit(None).cast("string"))
    named = F.concat(F.lit("Employer: Firm of "), F.col("source_name"), F.lit("\nwrite to hr@delta-foods.co.zw\n"), F.col("summary"))
    rows = backfill_company(jobs.withColumns({"summary": named, "job_description": F.lit(None).cast("string")}))
    return rows.filter("outcome is not null").select("id", "company", "content_hash", "outcome")


@query(
    "schema_evolution",
    A.with_views(A.JOBS_SQL)
    + "SELECT id, title, tags, department FROM jobs UNION ALL SELECT id, title, NULL, NULL FROM jobs WHERE featured",
)
def schema_evolution(spark, sf_dir):
    """Two snapshots, one without the optional columns, read as one table."""
    jobs = A.jobs(spark, sf_dir)
    new, old = fresh_path(spark, "jobs-new"), fresh_path(spark, "jobs-old")
    jobs.write.parquet(new)
    jobs.filter("featured").select("id", "title", "company", "location", "category", "summary", "apply_url").write.parquet(old)
    return T.read_jobs(spark, new, old).select("id", "title", "tags", "department")


@query(
    "snapshot_rebuild",
    A.with_views(A.JOBS_SQL, A.SAVED_SQL)
    + "SELECT 'jobs' AS table_name, (SELECT count(*) FROM jobs) AS before, (SELECT count(*) FROM jobs WHERE category = 'Gigs') AS after "
    "UNION ALL SELECT 'saved_jobs', (SELECT count(*) FROM saved), 0",
)
def snapshot_rebuild(spark, sf_dir):
    """Back up, clear and reload; row counts before and after."""
    jobs = A.jobs(spark, sf_dir)
    paths = {"jobs": fresh_path(spark, "jobs"), "saved_jobs": fresh_path(spark, "saved")}
    jobs.write.parquet(paths["jobs"])
    A.saved(spark, sf_dir).write.parquet(paths["saved_jobs"])
    _, _, counts = T.rebuild(spark, paths, jobs.filter("category = 'Gigs'"), fresh_path(spark, "rebuild"))
    return counts
