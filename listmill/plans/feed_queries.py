"""Feeds to raw records, the mapped records, and the event streams."""

import uuid

from pyspark.sql import functions as F

from .. import schema
from ..functions import vocab as V
from ..operators import identity as I
from ..operators import merge as M
from ..operators import reports as R
from ..session import cut_lineage, fresh_path, work_dir
from ..sources import feeds as FD
from ..sources import tables as T
from ..streaming import events as E
from . import adaptors as A
from . import duck as D
from .ingest import ingest, map_records, validate
from .registry import query

PER_PAYLOAD = 20    # documents per feed payload, so that a payload is of bounded size


def _items(spark, sf_dir):
    docs = A.texts(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return docs.select(
        k, F.floor(k / PER_PAYLOAD).alias("b"), "lang", "source",
        F.element_at(F.array(*[F.lit(r) for r in A.ROLES]), (k % 12 + 1).cast("int")).alias("role"),
        F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")).alias("html"),
    )


def _grouped(spark, sf_dir):
    """The documents of each payload, in order; payloads of every kind are made of these rows, so that texts are shuffled once."""
    return _items(spark, sf_dir).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("doc_id", "lang", "source", "role", "html"))).alias("xs"))


def _item(kind, c):
    """A document as an item of a payload; ``c`` gives its fields."""
    sid = c("doc_id").cast("string")
    lit, cat = F.lit, F.concat
    return {
        "jobicy_api": F.struct(
            c("doc_id").alias("id"), c("role").alias("jobTitle"), cat(lit("Firm "), c("source")).alias("companyName"),
            F.when(c("doc_id") % 2 == 0, lit("Africa")).alias("jobGeo"), cat(lit("https://feed.example.com/j/"), sid).alias("url"),
            c("html").alias("jobDescription"), F.array(lit("Full-Time")).alias("jobType"), F.array(c("lang"), c("source")).alias("jobIndustry"),
            lit("2024-05-03 10:00:00").alias("pubDate"),
        ),
        "remoteok_api": F.struct(
            sid.alias("id"), c("role").alias("position"), cat(lit("Firm "), c("source")).alias("company"), lit("").alias("location"),
            c("html").alias("description"), cat(lit("/remote/"), sid).alias("url"), lit("2024-05-03T00:00:00+00:00").alias("date"),
            F.when(c("doc_id") % 2 == 0, 1000).otherwise(0).alias("salary_min"), lit(2000).alias("salary_max"),
            F.array(lit("a"), lit("b"), c("lang"), lit("d"), lit("e"), lit("f")).alias("tags"),
        ),
        "reliefweb_api": F.struct(
            sid.alias("id"),
            F.struct(
                c("role").alias("title"), F.array(F.struct(cat(lit("Org "), c("source")).alias("name"))).alias("source"),
                F.array(F.struct(lit("Zimbabwe").alias("name"))).alias("country"), F.array(F.struct(lit("Harare").alias("name")), F.struct(lit("Gweru").alias("name"))).alias("city"),
                c("html").alias("body-html"), cat(lit("/job/"), sid).alias("url_alias"),
                F.struct(lit("2024-05-01T00:00:00+00:00").alias("created"), lit("2024-06-30T00:00:00+00:00").alias("closing")).alias("date"),
                F.array(F.struct(lit("Logistics").alias("name")), F.struct(lit("Health").alias("name"))).alias("career_categories"),
            ).alias("fields"),
        ),
        "greenhouse_api": F.struct(
            c("doc_id").alias("id"), c("role").alias("title"), F.struct(F.when(c("doc_id") % 2 == 0, lit("Remote - EMEA")).otherwise(lit("Lusaka")).alias("name")).alias("location"),
            c("html").alias("content"), cat(lit("https://boards.example.io/acme-"), c("lang"), lit("/jobs/"), sid).alias("absolute_url"),
            F.array(F.struct(lit("Ops").alias("name")), F.struct(lit("Care").alias("name"))).alias("departments"), lit("2024-05-02T11:00:00Z").alias("updated_at"),
        ),
        "lever_api": F.struct(
            sid.alias("id"), c("role").alias("text"), F.struct(lit("Nairobi").alias("location"), c("source").alias("team"), lit("Contract").alias("commitment")).alias("categories"),
            c("html").alias("description"), cat(lit("https://hire.example.co/"), c("lang"), lit("/"), sid).alias("hostedUrl"),
        ),
    }[kind]


def payloads(spark, sf_dir, kind):
    """Feed payloads made of the documents, a bounded number per payload; one in seven is broken."""
    lit, cat = F.lit, F.concat
    rows = _grouped(spark, sf_dir)
    items = F.to_json(F.transform("xs", lambda x: _item(kind, x.getField)))
    wrap = {"jobicy_api": ('{"jobs":', "}"), "remoteok_api": ("", ""), "reliefweb_api": ('{"data":', "}"), "greenhouse_api": ('{"jobs":', "}"), "lever_api": ("", "")}[kind]
    text = cat(lit(wrap[0]), items, lit(wrap[1]))
    if kind == "remoteok_api":
        text = cat(lit('[{"legal":"terms"},'), F.substr(items, F.lit(2)))
    broken = F.when(F.col("b") % 7 == 6, F.substr(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    return rows.select(lit(f"{kind}_src").alias("source_name"), lit("https://api.example.com/feed/acme-co").alias("url"), broken.alias("payload"))


def settings(spark):
    rows = [(f"{k}_src", k, "Remote / Worldwide", "Other") for k in FD.FEED_TYPES]
    return spark.createDataFrame(rows, "source_name string, type string, default_location string, default_category string")


_ITEMS = (
    f"it AS (SELECT doc_id, lang, source, {A._pick_expr(A.ROLES, 'doc_id % 12')} AS role FROM documents WHERE (doc_id // {PER_PAYLOAD}) % 7 <> 6)"
)


@query(
    "feed_flatten_jobicy",
    f"WITH {_ITEMS} SELECT cast(doc_id AS varchar) AS external_id, role AS title, 'Firm ' || source AS company, CASE WHEN doc_id % 2 = 0 THEN 'Africa' ELSE 'Remote / Worldwide' END AS location, "
    "'https://feed.example.com/j/' || doc_id AS source_url, '2024-05-03' AS posted_at, lang || ', ' || source AS department, 'Full-Time' AS employment_type, 'Remote' AS remote_status FROM it",
)
def feed_flatten_jobicy(spark, sf_dir):
    rows = FD.jobicy(payloads(spark, sf_dir, "jobicy_api"), settings(spark))
    return rows.select("external_id", "title", "company", "location", "source_url", "posted_at", "department", "employment_type", "remote_status")


@query(
    "feed_flatten_remoteok",
    f"WITH {_ITEMS} SELECT cast(doc_id AS varchar) AS external_id, role AS title, 'Firm ' || source AS company, 'Remote / Worldwide' AS location, 'https://api.example.com/remote/' || doc_id AS source_url, "
    "'2024-05-03' AS posted_at, 'a, b, ' || lang || ', d, e' AS department, CASE WHEN doc_id % 2 = 0 THEN 'USD 1000 - 2000' END AS salary_range FROM it",
)
def feed_flatten_remoteok(spark, sf_dir):
    rows = FD.remoteok(payloads(spark, sf_dir, "remoteok_api"), settings(spark))
    return rows.select("external_id", "title", "company", "location", "source_url", "posted_at", "department", "salary_range")


@query(
    "feed_flatten_reliefweb",
    f"WITH {_ITEMS} SELECT cast(doc_id AS varchar) AS external_id, role AS title, 'Org ' || source AS company, 'Harare, Gweru, Zimbabwe' AS location, 'https://reliefweb.int/job/' || doc_id AS source_url, "
    "'2024-05-01' AS posted_at, '2024-06-30' AS expires_at, 'Logistics, Health' AS department, 'Logistics' AS employment_type FROM it",
)
def feed_flatten_reliefweb(spark, sf_dir):
    rows = FD.reliefweb(payloads(spark, sf_dir, "reliefweb_api"), settings(spark))
    return rows.select("external_id", "title", "company", "location", "source_url", "posted_at", "expires_at", "department", "employment_type")


@query(
    "feed_flatten_greenhouse",
    f"WITH {_ITEMS} SELECT cast(doc_id AS varchar) AS external_id, role AS title, 'Acme ' || upper(substr(lang, 1, 1)) || substr(lang, 2) AS company, CASE WHEN doc_id % 2 = 0 THEN 'Remote - EMEA' ELSE 'Lusaka' END AS location, "
    "'https://boards.example.io/acme-' || lang || '/jobs/' || doc_id AS source_url, '2024-05-02' AS posted_at, 'Ops, Care' AS department, CASE WHEN doc_id % 2 = 0 THEN 'Remote' END AS remote_status FROM it",
)
def feed_flatten_greenhouse(spark, sf_dir):
    rows = FD.greenhouse(payloads(spark, sf_dir, "greenhouse_api"), settings(spark))
    return rows.select("external_id", "title", "company", "location", "source_url", "posted_at", "department", "remote_status")


@query(
    "feed_flatten_lever",
    f"WITH {_ITEMS} SELECT cast(doc_id AS varchar) AS external_id, role AS title, 'Acme Co' AS company, 'Nairobi' AS location, 'https://hire.example.co/' || lang || '/' || doc_id AS source_url, source AS department, 'Contract' AS employment_type FROM it",
)
def feed_flatten_lever(spark, sf_dir):
    rows = FD.lever(payloads(spark, sf_dir, "lever_api"), settings(spark))
    return rows.select("external_id", "title", "company", "location", "source_url", "department", "employment_type")


def rss_payloads(spark, sf_dir):
    lit = F.lit

    def item(c):
        esc = F.replace(F.replace(c("html"), lit("&"), lit("&amp;")), lit("<"), lit("&lt;"))
        return F.concat(
            lit("<item><title>Firm "), c("source"), lit(": "), c("role"), lit("</title><link>https://rss.example.com/"), c("doc_id").cast("string"),
            lit("</link><pubDate>Fri, 03 May 2024 10:00:00 +0000</pubDate><category>"), c("lang"), lit("</category><category>Worldwide</category><description>"),
            F.regexp_replace(esc, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), lit("</description></item>"),
        )

    rows = _grouped(spark, sf_dir)
    body = F.array_join(F.transform("xs", lambda x: item(x.getField)), "")
    end = F.when(F.col("b") % 7 == 6, lit("</chan")).otherwise(lit("</channel></rss>"))
    return rows.select(lit("rss_src").alias("source_name"), lit("https://rss.example.com/feed").alias("url"), F.concat(lit("<rss><channel>"), body, end).alias("payload"))


@query(
    "rss_flatten",
    f"WITH {_ITEMS} SELECT 'https://rss.example.com/' || doc_id AS source_url, role AS title, 'Firm ' || source AS company, 'Remote / Worldwide' AS location, '2024-05-03' AS posted_at, 'Remote' AS remote_status FROM it",
)
def rss_flatten(spark, sf_dir):
    rows = FD.rss(rss_payloads(spark, sf_dir), settings(spark))
    return rows.select("source_url", "title", "company", "location", "posted_at", "remote_status")


def _all_payloads(spark, sf_dir):
    out = rss_payloads(spark, sf_dir)
    for k in ("jobicy_api", "remoteok_api", "reliefweb_api", "greenhouse_api", "lever_api"):
        out = out.unionByName(payloads(spark, sf_dir, k))
    return out


@query(
    "feed_routing",
    f"WITH {_ITEMS}, n AS (SELECT count(*) AS n FROM it) SELECT s AS source_name, n FROM n, (VALUES ('rss_src'), ('jobicy_api_src'), ('remoteok_api_src'), ('reliefweb_api_src'), ('greenhouse_api_src'), ('lever_api_src')) t(s)",
)
def feed_routing(spark, sf_dir):
    """A mix of feeds, each flattened by its source's type; records per source."""
    return FD.route(_all_payloads(spark, sf_dir), settings(spark)).groupBy("source_name").agg(F.count("*").alias("n"))


_PAGES_OF = "CASE page_id % 3 WHEN 0 THEN 'pages_src' WHEN 1 THEN 'odd_src' ELSE 'stranger_src' END"


@query(
    "routing_counts",
    f"WITH {_ITEMS}, n AS (SELECT count(*) AS n FROM it), b AS (SELECT count(DISTINCT doc_id // {PER_PAYLOAD}) AS p, count(DISTINCT doc_id // {PER_PAYLOAD}) FILTER (WHERE doc_id // {PER_PAYLOAD} % 7 = 6) AS bad FROM documents) "
    "SELECT s AS source_name, p AS n_payloads, bad AS n_bad, n AS n_records FROM n, b, (VALUES ('rss_src'), ('jobicy_api_src'), ('remoteok_api_src'), ('reliefweb_api_src'), ('greenhouse_api_src'), ('lever_api_src')) t(s) "
    f"UNION ALL SELECT {_PAGES_OF}, count(*), 0, count(*) * 2 FROM pages GROUP BY 1",
)
def routing_counts(spark, sf_dir):
    """Payloads, unreadable payloads and records per source of a mix of feeds and pages; a third of the pages comes
    from a source of an unknown type and a third from one without settings."""
    name = F.when(F.col("page_id") % 3 == 0, "pages_src").when(F.col("page_id") % 3 == 1, "odd_src").otherwise("stranger_src")
    pages = A.card_pages(spark, sf_dir).select(name.alias("source_name"), "url", F.col("html").alias("payload"))
    kinds = settings(spark)
    extra = spark.createDataFrame([("pages_src", "generic"), ("odd_src", "carrier_pigeon")], "source_name string, type string")
    return FD.routing_counts(_all_payloads(spark, sf_dir).unionByName(pages), kinds.unionByName(extra, allowMissingColumns=True))


@query(
    "unreadable_payloads",
    f"WITH b AS (SELECT DISTINCT doc_id // {PER_PAYLOAD} AS b FROM documents) SELECT s AS source_name, count(*) AS n_bad FROM b, (VALUES ('rss_src'), ('jobicy_api_src'), ('remoteok_api_src'), ('reliefweb_api_src'), ('greenhouse_api_src'), ('lever_api_src')) t(s) WHERE b % 7 = 6 GROUP BY s",
)
def unreadable_payloads(spark, sf_dir):
    """Payloads of every feed type that don't parse."""
    return FD.unreadable(_all_payloads(spark, sf_dir))


# ------------------------------------------------------------------ mapping and ingest
def raw_records(spark, sf_dir):
    """Listings as raw records of their sources."""
    j = A.jobs(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    return j.select(
        F.col("id").alias("ord"), "source_name", "source_url", "title", nothing.alias("company"), nothing.alias("location"),
        "category", F.col("job_description").alias("summary"), nothing.alias("description_html"), "apply_url", "posted_at",
        nothing.alias("expires_at"), nothing.alias("department"), nothing.alias("employment_type"), nothing.alias("salary_range"),
        nothing.alias("remote_status"), F.col("external_job_id").alias("external_id"), nothing.alias("requirements"),
    )


def source_settings(spark, sf_dir):
    names = A.texts(spark, sf_dir, "documents").select(F.col("source").alias("source_name")).distinct()
    return names.select(
        "source_name", F.lit("Zimbabwe").alias("default_location"), F.lit("Other").alias("default_category"),
        F.lit(None).cast("string").alias("default_company"),
        F.when(F.col("source_name").rlike("[05]$"), F.array(F.lit("Harare"), F.lit("Remote"))).otherwise(F.array().cast("array<string>")).alias("allowed_locations"),
        F.lit(True).alias("skip_expired"),
    )


@query("map_records")
def map_records_query(spark, sf_dir):
    """Raw records to normalised listings."""
    return map_records(raw_records(spark, sf_dir), source_settings(spark, sf_dir)).select(
        "ord", "title", "company", "location", "category", "employment_type", "salary_range", "expires_at", "remote_status",
        "department", "apply_url", "source_url", "external_job_id", "content_hash", "summary",
    )


def _checked(spark, sf_dir):
    return validate(map_records(raw_records(spark, sf_dir), source_settings(spark, sf_dir)), A.as_of_date())


@query("ingest_counters")
def ingest_counters(spark, sf_dir):
    """Per source: raw, valid, invalid, kept after de-duplication."""
    checked = cut_lineage(_checked(spark, sf_dir))
    return R.ingest_counters(checked, I.dedupe_batch(checked.filter("ok"), "ord"))


@query("reject_reason_counts")
def reject_reason_counts(spark, sf_dir):
    return R.reason_counts(cut_lineage(_checked(spark, sf_dir).select("reasons")))


@query("url_counts", A.with_views(A.JOBS_SQL) + "SELECT count(DISTINCT source_url) AS n_urls FROM jobs")
def url_counts(spark, sf_dir):
    return R.count_urls(A.jobs(spark, sf_dir), "source_url")


# ------------------------------------------------------------------ streams
def _event_stream(spark, sf_dir):
    e = A.prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    s = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return s.filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"), k.alias("offer_id"), F.concat(F.lit("  p"), (k % 5).cast("string")).alias("placement_id"),
        F.when(F.col("event_type") == "view", "impression").otherwise("click").alias("event_type"),
        "user_id", F.col("ts").cast("timestamp").alias("created_at"),
    )


def _run(df, path, mode, spark):
    """Run a stream over what is there now; each micro-batch replaces or adds to the output."""

    def write(batch, batch_id):
        folder = f"{path}/out" if mode == "complete" else f"{path}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)

    (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{path}/out").drop("batch")


@query(
    "stream_placement_counts",
    A.with_views(A.EVENTS_SQL, A.OFFERS_SQL)
    + "SELECT placement_id, count(*) FILTER (WHERE event_type = 'impression') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM ev "
    "WHERE offer_id IN (SELECT id FROM offers WHERE is_active) GROUP BY 1",
)
def stream_placement_counts(spark, sf_dir):
    """Event stream: accepted events of active offers, running counts by placement."""
    accepted = E.accept_events(_event_stream(spark, sf_dir), A.offers(spark, sf_dir))
    return _run(E.running_counts(accepted), fresh_path(spark, "stream-counts"), "complete", spark)


_WINDOW_DAYS, _LATE_DAYS, _STEPS = 7, 2, 6


def _timed_files(spark, sf_dir, columns):
    """The event log as a folder of files that arrive in order of time, in _STEPS steps of equal length."""
    e = A.prepare(spark).read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "props", F.col("ts").cast("timestamp").alias("ts"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    step = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * _STEPS / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
    rows = cut_lineage(e.select(*columns, step.alias("_step")))
    folder = fresh_path(spark, "event-files")
    for k in range(_STEPS):
        rows.filter(F.col("_step") == k).drop("_step").write.mode("append").parquet(f"{folder}/step={k}")
    files = spark.read.parquet(folder).drop("step")
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(folder)


@query(
    "stream_window_counts",
    A.with_views(A.EVENTS_SQL, A.OFFERS_SQL)
    + ", a AS (SELECT * FROM ev WHERE offer_id IN (SELECT id FROM offers WHERE is_active)), "
    f"w AS (SELECT *, make_timestamp(epoch_us(created_at) // {_WINDOW_DAYS * 86_400_000_000} * {_WINDOW_DAYS * 86_400_000_000}) AS w0 FROM a) "
    f"SELECT CAST(w0 AS VARCHAR) AS window_start, placement_id, count(*) FILTER (WHERE event_type = 'impression') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks "
    f"FROM w WHERE w0 + INTERVAL {_WINDOW_DAYS} DAY <= (SELECT date_trunc('millisecond', max(created_at)) FROM a) - INTERVAL {_LATE_DAYS} DAY GROUP BY 1, 2",
)
def stream_window_counts(spark, sf_dir):
    """Counts by placement and week from a stream in append mode: a week comes out once the watermark has passed it."""
    s = _timed_files(spark, sf_dir, ["event_id", "event_type", "user_id", "props", "ts"])
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = s.filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"), k.alias("offer_id"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("placement_id"),
        F.when(F.col("event_type") == "view", "impression").otherwise("click").alias("event_type"), F.col("ts").alias("created_at"),
    )
    accepted = E.accept_events(log, A.offers(spark, sf_dir))
    counts = E.running_counts(accepted, window=f"{_WINDOW_DAYS} days", watermark=f"{_LATE_DAYS} days")
    out = _run(counts, fresh_path(spark, "stream-windows"), "append", spark)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "placement_id", "impressions", "clicks")


LIMIT, WINDOW = 2, 3 * 24 * 3600      # with the test log's rates some requests are rejected

_ADMIT_SQL = (
    "WITH RECURSIVE q AS (SELECT event_id AS request_id, event_type AS scope, user_id AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events), "
    "w AS (SELECT scope, client, n, request_id, [us] AS held, true AS admitted FROM q WHERE n = 1 UNION ALL "
    f"SELECT q.scope, q.client, q.n, q.request_id, CASE WHEN len(list_filter(held, lambda t: t > us - {WINDOW * 1_000_000})) < {LIMIT} THEN list_append(list_filter(held, lambda t: t > us - {WINDOW * 1_000_000}), us) "
    f"ELSE list_filter(held, lambda t: t > us - {WINDOW * 1_000_000}) END, len(list_filter(held, lambda t: t > us - {WINDOW * 1_000_000})) < {LIMIT} "
    "FROM w JOIN q ON q.scope = w.scope AND q.client = w.client AND q.n = w.n + 1) SELECT scope, client, request_id, admitted FROM w"
)


@query("rate_limit_stream", _ADMIT_SQL)
def rate_limit_stream(spark, sf_dir):
    """Sliding-window admission of a request log as a stream in order of time; rejected requests do not count."""
    s = _timed_files(spark, sf_dir, ["event_id", "event_type", "user_id", "ts"])
    requests = s.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("scope"), F.col("user_id").alias("client"), "ts")
    log = E.AdmissionLog(spark, fresh_path(spark, "stream-admission"), "ts", LIMIT, WINDOW)
    E.admit_stream(requests, log).awaitTermination()
    return log.answers()


class SnapshotStore:
    """Versioned snapshots in a shared folder; what is current is read from its commit log.

    A batch starts from the last snapshot of an earlier batch and writes to a folder of its own, so a batch that is tried
    again repeats the same work and supersedes its first try. Its time is noted before its first try and read by later ones.
    """

    LOG = "batch bigint, at timestamp, folder string"
    BEGUN = "batch bigint, at string"

    def __init__(self, spark, root, first):
        self.spark, self.root = spark, root
        self._log(-1, first)

    def _log(self, batch_id, snapshot):
        folder = f"{self.root}/snapshot={batch_id}-{uuid.uuid4().hex}"
        snapshot.write.parquet(folder)
        entry = self.spark.createDataFrame([(batch_id, folder)], "batch bigint, folder string")
        entry.select("batch", F.current_timestamp().alias("at"), "folder").write.mode("append").parquet(f"{self.root}/log")

    def begin(self, batch_id):
        now = self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.current_timestamp().cast("string").alias("at"))
        now.write.mode("append").parquet(f"{self.root}/begun")
        begun = self.spark.read.schema(self.BEGUN).parquet(f"{self.root}/begun")
        return begun.filter(F.col("batch") == batch_id).agg(F.min("at")).first()[0]

    def read(self, before=2**62):
        log = self.spark.read.schema(self.LOG).parquet(f"{self.root}/log").filter(F.col("batch") < before)
        folder = log.agg(F.max_by("folder", F.struct("batch", "at")).alias("f")).first().f
        return self.spark.read.schema(schema.JOBS).parquet(folder)

    def quarantine(self, batch_id, payloads):
        payloads.write.mode("overwrite").parquet(f"{self.root}/bad/batch={batch_id}")

    def commit(self, batch_id, snapshot, actions, checked):
        self._log(batch_id, snapshot)
        M.action_counts(actions).write.mode("overwrite").parquet(f"{self.root}/counts/batch={batch_id}")
        M.changed_urls(actions, A.SITE).write.mode("overwrite").parquet(f"{self.root}/changed/batch={batch_id}")


def ingest_settings(spark):
    return settings(spark).select(
        "source_name", "default_location", "default_category", F.lit(None).cast("string").alias("default_company"),
        F.array().cast("array<string>").alias("allowed_locations"), F.lit(True).alias("skip_expired"),
    )


def ingest_folder(spark, folder, store, checkpoint, files_per_batch=1000, flatten=None):
    """All payload files of a folder through the ingest stream; of every type unless ``flatten`` reads one."""
    known = settings(spark)
    read = flatten or FD.route
    E.ingest_stream(
        spark, folder, schema.FEED_PAYLOADS, lambda p: read(p, known), ingest_settings(spark), store, A.as_of_date(), checkpoint, files_per_batch,
        types=known if flatten is None else None,
    ).awaitTermination()


@query("incremental_ingest")
def incremental_ingest(spark, sf_dir):
    """New payload files, which hold every document, to listings, one merge per micro-batch."""
    folder = fresh_path(spark, "payloads")
    payloads(spark, sf_dir, "jobicy_api").write.parquet(folder)
    store = SnapshotStore(spark, fresh_path(spark, "store"), spark.createDataFrame([], schema.JOBS))
    ingest_folder(spark, folder, store, fresh_path(spark, "ingest-checkpoint"), flatten=FD.jobicy)
    return store.read().select("id", "title", "company", "location", "category", "source_url", "external_job_id")
