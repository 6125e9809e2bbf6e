"""Counts, click reports and dashboard figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def views() -> Column:
    return F.count_if(F.col("event_type") == "impression")


def clicks() -> Column:
    return F.count_if(F.col("event_type") == "click")


def ctr(n_views: Column, n_clicks: Column) -> Column:
    """Clicks per hundred views, one decimal, 0 without views."""
    return F.when(n_views > 0, F.round(100.0 * n_clicks / n_views, 1)).otherwise(F.lit(0.0))


def event_totals(events: DataFrame) -> DataFrame:
    """Overall sums; null, not 0, when there are no events."""
    one = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).cast("bigint")
    return events.agg(one("impression").alias("impressions"), one("click").alias("clicks"))


def events_by_placement(events: DataFrame) -> DataFrame:
    rows = events.groupBy("placement_id").agg(views().alias("impressions"), clicks().alias("clicks"))
    return rows.withColumn("ctr", ctr(F.col("impressions"), F.col("clicks")))


def events_by_offer(offers: DataFrame, events: DataFrame) -> DataFrame:
    """Sums for every offer, 0 for one without events; events are reduced before the join."""
    per_offer = events.groupBy("offer_id").agg(views().alias("v"), clicks().alias("c"))
    rows = offers.join(per_offer, offers["id"] == per_offer["offer_id"], "left")
    rows = rows.withColumns(
        {"impressions": F.coalesce("v", F.lit(0)), "clicks": F.coalesce("c", F.lit(0))}
    ).drop("v", "c", "offer_id")
    return rows.withColumn("ctr", ctr(F.col("impressions"), F.col("clicks")))


def report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("clicks"), F.desc("impressions"), F.desc("priority_score"), F.desc("id"))


def offer_list_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("is_active"), F.desc("priority_score"), F.desc("updated_at"), F.desc("id"))


def recent_events(events: DataFrame, offers: DataFrame, n: int = 50) -> DataFrame:
    """Newest events with the offer's title. Events of unknown offers drop out before the limit."""
    names = offers.select(F.col("id").alias("offer_id"), "display_title")
    return events.join(names, "offer_id").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def join_saved(saved: DataFrame, jobs: DataFrame, user_id=None) -> DataFrame:
    """Bookmarked listings with the time of the bookmark; of one user when given."""
    if user_id is not None:
        saved = saved.filter(F.col("user_id") == user_id)
    marks = saved.select("user_id", F.col("job_id").alias("id"), F.col("created_at").alias("saved_at"))
    return jobs.join(marks, "id")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def dashboard(jobs, users, saved, events, as_of: Column) -> DataFrame:
    """One row of figures: one aggregate per table, read as scalar subqueries."""
    parts = [
        jobs.agg(F.count("*").alias("jobs"), F.count_if("featured").alias("featured")),
        users.agg(
            F.count("*").alias("users"),
            F.count_if(F.col("created_at") >= as_of - F.expr("interval 7 days")).alias("new_users"),
        ),
        saved.agg(F.count("*").alias("saved")),
        events.agg(clicks().alias("aff_clicks"), views().alias("aff_impressions")),
    ]
    row = lambda p: p.select(F.struct("*")).scalar()
    rest = parts[0].select("*", *[row(p).alias(f"r{i}") for i, p in enumerate(parts[1:])])
    return rest.select("jobs", "featured", "r0.*", "r1.*", "r2.*")


def top_recent(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ingest_counters(validated: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per source: raw, valid, invalid and kept after de-duplication."""
    a = validated.groupBy("source_name").agg(
        F.count("*").alias("raw"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid")
    )
    b = accepted.groupBy("source_name").agg(F.count("*").alias("deduped"))
    return a.join(b, "source_name", "left").withColumn("deduped", F.coalesce("deduped", F.lit(0)))


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def count_urls(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_urls"))


def dropped_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that occur more than once in one record, by comparison key."""
    from ..functions.text import block_lines, fold

    rows = df.select(key, F.explode(block_lines(F.col(text))).alias("line"))
    return (
        rows.select(key, fold(F.col("line")).alias("line_key"))
        .filter("line_key <> ''")
        .groupBy(key, "line_key")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def line_stats(df: DataFrame, order: str, text: str) -> DataFrame:
    """Every line of all records by comparison key: line_key, n_lines, n_rows, and where it is first (row, place, line).

    Two levels of counting: first inside each record, so that a line which most records hold is spread over them, and
    then over records, combined inside tasks before the shuffle.
    """
    from ..functions.text import block_lines, fold

    lines = df.select(F.col(order).alias("row"), F.posexplode(block_lines(F.col(text))).alias("pos", "line"))
    lines = lines.withColumn("line_key", fold(F.col("line"))).filter("line_key <> ''")
    inside = lines.groupBy("line_key", "row").agg(F.count("*").alias("n"), F.min(F.struct("pos", "line")).alias("at"))
    total = inside.groupBy("line_key").agg(
        F.sum("n").alias("n_lines"), F.count("*").alias("n_rows"), F.min(F.struct("row", "at.pos", "at.line")).alias("first")
    )
    return total.select(
        "line_key", "n_lines", "n_rows", F.col("first.row").alias("first_row"), F.col("first.pos").cast("bigint").alias("first_pos"), F.col("first.line").alias("first_line")
    )


def repeated_lines(stats: DataFrame) -> DataFrame:
    """The report of lines that occur more than once in the corpus."""
    return stats.filter("n_lines > 1")


def without_repeats(df: DataFrame, order: str, text: str, stats: DataFrame, n_rows: int) -> DataFrame:
    """``df`` with ``text`` freed of lines that ``n_rows`` records or more hold, but for each line's first place."""
    from ..functions.text import block_lines, fold

    common = stats.filter(F.col("n_rows") >= n_rows).select("line_key", "first_row", "first_pos")
    lines = df.select(F.col(order).alias("row"), F.posexplode(block_lines(F.col(text))).alias("pos", "line")).withColumn("line_key", fold(F.col("line")))
    kept = lines.join(common, "line_key", "left").filter(
        F.col("first_row").isNull() | ((F.col("row") == F.col("first_row")) & (F.col("pos") == F.col("first_pos")))
    )
    built = kept.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("_new"))
    return df.join(built, F.col(order) == F.col("row"), "left").withColumn(text, F.when(F.col(text).isNotNull(), F.coalesce("_new", F.lit("")))).select(*df.columns)
