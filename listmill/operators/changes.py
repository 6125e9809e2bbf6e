"""Change feeds between two snapshots, and URL batches for publishing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.quality import is_public
from ..functions.text import slug
from ..functions.urls import job_path, public_url
from .merge import trimmed
from .scan import number_rows


def _material(df: DataFrame) -> Column:
    cols = [c for c in V.PUBLISH_COLUMNS if c in df.columns]
    return F.sha2(F.to_json(F.struct(*[trimmed(F.col(c)).alias(c) for c in cols])), 256)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change (insert, update, delete, same) on the material columns; null equals empty."""
    b = before.select("id", _material(before).alias("b"))
    a = after.select("id", _material(after).alias("a"))
    change = (
        F.when(F.col("b").isNull(), "insert")
        .when(F.col("a").isNull(), "delete")
        .when(F.col("a") != F.col("b"), "update")
        .otherwise("same")
    )
    return b.join(a, "id", "full_outer").select("id", change.alias("change"))


def visibility(before: DataFrame, after: DataFrame, as_of_date: Column) -> DataFrame:
    """Listings to announce: hidden now, or new or changed and public now."""
    b = before.select(
        "id", F.col("title").alias("old_title"), _material(before).alias("b"), is_public(before, as_of_date).alias("was")
    )
    a = after.select("id", "title", _material(after).alias("a"), is_public(after, as_of_date).alias("now"))
    rows = b.join(a, "id", "full_outer")
    event = (
        F.when(F.coalesce("was", F.lit(False)) & F.col("a").isNotNull() & ~F.col("now"), "hidden")
        .when(F.coalesce("now", F.lit(False)) & F.col("b").isNull(), "published")
        .when(F.coalesce("now", F.lit(False)) & (F.col("a") != F.col("b")), "changed")
    )
    title = F.when(event == "hidden", F.col("old_title")).otherwise(F.col("title"))
    path = job_path(F.col("id"), title, slug)
    return rows.select("id", event.alias("event"), path.alias("path")).filter("event is not null")


def url_batches(urls: DataFrame, url: str, pos: str, base: str, size: int = V.URL_BATCH_SIZE) -> DataFrame:
    """Publishable URLs, each once, numbered by first position and cut into batches.

    Row form: (url, n, batch, single). A batch holds at most ``size`` URLs by definition,
    so ``collect_batches`` may gather one per row.
    """
    ok = urls.select(public_url(F.col(url), base).alias("url"), F.col(pos).cast("bigint").alias("pos"))
    first = ok.filter("url is not null").groupBy("url").agg(F.min("pos").alias("pos"))
    numbered = number_rows(first, "pos", "n")
    total = first.agg(F.count("*")).scalar()
    return numbered.select(
        "url", F.col("n").cast("bigint").alias("n"),
        F.floor((F.col("n") - 1) / size).cast("bigint").alias("batch"),
        (total == 1).alias("single"),
    )


def collect_batches(batches: DataFrame) -> DataFrame:
    """One row per batch with its URLs in order."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("n", "url"))), lambda s: s["url"])
    return batches.groupBy("batch").agg(in_order.alias("urls"), F.count("*").alias("n_urls"))
