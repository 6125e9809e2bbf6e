"""Snapshot merges: upsert, overlay, delete, cascade. Each reads a snapshot and gives the next."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.quality import closed, expired, stored_bad_content
from ..functions.text import slug
from ..functions.urls import public_url
from ..session import cut_lineage
from .resolve import material_change, resolve, trimmed
from .scan import number_rows


def changed_columns(columns, before, after) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(after(c).isNotNull() & (trimmed(before(c)) != trimmed(after(c))), F.lit(c))
                for c in columns
            ]
        )
    )


def merge_actions(stored: DataFrame, incoming: DataFrame, order: str, dry_run: bool = False) -> DataFrame:
    """One row per incoming record: order, stored_id, batch_ord, action, and the record's columns.

    Each record is compared with the state its predecessors left, stored or inserted, as a row-by-row upsert would. A
    dry run writes nothing in between, so its records are compared with the stored rows alone.
    """
    return resolve(incoming, stored, order, within_batch=not dry_run)


def overlay(stored: DataFrame, updates: DataFrame, order: str, columns) -> DataFrame:
    """Write the last non-null value of each column over the stored row; null never erases."""
    last = updates.groupBy("stored_id").agg(
        *[
            F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))).alias(f"new_{c}")
            for c in columns
        ]
    )
    joined = stored.join(last, stored["id"] == last["stored_id"], "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"new_{c}")["v"], F.col(c)).alias(c) if c in columns else F.col(c)
            for c in stored.columns
        ]
    )


def assign_ids(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Give new rows the ids after the largest stored one, in their own order."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    return number_rows(new, order, "_n").withColumn("id", (F.col("_n") + top).cast("bigint")).drop("_n")


def merge_jobs(stored: DataFrame, incoming: DataFrame, order: str, actions: DataFrame | None = None):
    """(next snapshot, actions with the id each record ended up with)."""
    acts = cut_lineage(merge_actions(stored, incoming, order) if actions is None else actions)
    columns = [c for c in [*V.MERGE_COLUMNS, "scraped_at"] if c in stored.columns and c in incoming.columns]
    fresh = cut_lineage(assign_ids(stored, acts.filter("action = 'inserted'"), order))
    inserted = fresh.select(
        *[
            F.col(c).cast(stored.schema[c].dataType) if c in fresh.columns
            else F.lit(None).cast(stored.schema[c].dataType).alias(c)
            for c in stored.columns
        ]
    )
    # a record may belong to a listing that this batch inserted
    given = fresh.select(F.col(order).alias("_by"), F.col("id").alias("_new_id"))
    by = F.coalesce(F.col("batch_ord"), F.when(F.col("action") == "inserted", F.col(order).cast("bigint")))
    done = cut_lineage(
        acts.withColumn("_by", by).join(given.withColumn("_by", F.col("_by").cast("bigint")), "_by", "left")
        .withColumn("id", F.coalesce("stored_id", "_new_id")).drop("_by", "_new_id")
    )
    updates = done.filter("action = 'updated'").drop("stored_id").withColumnRenamed("id", "stored_id")
    return overlay(stored.unionByName(inserted), updates, order, columns), done


def action_counts(actions: DataFrame) -> DataFrame:
    """One row: how many records were inserted, updated, skipped, and failed."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "skipped", "failed")])


def split_by(df: DataFrame, condition: Column):
    """(rows that stay, rows that go); a null condition stays."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def delete_expired(jobs: DataFrame, as_of_date: Column):
    return split_by(jobs, expired(F.col("expires_at"), as_of_date))


def purge_closed(jobs: DataFrame, as_of_date: Column):
    return split_by(jobs, closed(F.col("tags"), F.col("expires_at"), as_of_date))


def _stored_bad(jobs: DataFrame) -> Column:
    get = lambda n: F.col(n) if n in jobs.columns else F.lit(None).cast("string")
    return stored_bad_content(
        get("summary"), get("job_description"), get("requirements"), get("apply_url"), get("source_url")
    )


def delete_bad(jobs: DataFrame):
    return split_by(jobs, _stored_bad(jobs))


def cascade(dependent: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Dependent rows whose parent was not deleted."""
    return dependent.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def clean_jobs(jobs: DataFrame, saved: DataFrame, as_of_date: Column, bad_content: bool = True):
    """Maintenance run: (jobs left, bookmarks left, one row of counters)."""
    late = expired(F.col("expires_at"), as_of_date)
    bad = F.coalesce(_stored_bad(jobs), F.lit(False)) if bad_content else F.lit(False)
    # the expired go first, so a row that is both counts as expired
    why = jobs.withColumn(
        "_why", F.when(late, F.lit("expired")).when(bad, F.lit("bad")).otherwise(F.lit("kept"))
    )
    left = why.filter("_why = 'kept'").drop("_why")
    gone = why.filter("_why <> 'kept'").drop("_why")
    counters = why.agg(
        F.count_if(F.col("_why") == "expired").alias("expired_jobs"),
        F.count_if(F.col("_why") == "bad").alias("bad_description_jobs"),
        F.count_if(F.col("_why") != "kept").alias("deleted"),
        F.count_if(F.col("_why") == "kept").alias("total_jobs"),
    )
    return left, cascade(saved, gone, "job_id"), counters


def upsert_alerts(stored: DataFrame, incoming: DataFrame, order: str, now: Column) -> DataFrame:
    """Alert sign-ups by (email, category, location): reactivate, keep the first token."""
    keys = ["email", "category", "location"]
    agg = incoming.groupBy(*keys).agg(
        F.max(F.struct(order, "source", "frequency")).alias("n"),
        F.min(F.struct(order, F.col("unsubscribe_token").alias("t"))).alias("f"),
    )
    joined = stored.join(agg, keys, "full_outer")
    signed = F.col("n").isNotNull()
    present = F.col("unsubscribe_token").isNotNull()
    out = {
        "source": F.when(signed, F.col("n.source")).otherwise(F.col("source")),
        "frequency": F.when(signed, F.col("n.frequency")).otherwise(F.col("frequency")),
        "active": signed | F.coalesce(F.col("active"), F.lit(False)),
        "unsubscribe_token": F.coalesce("unsubscribe_token", "f.t"),
        "unsubscribed_at": F.when(~signed, F.col("unsubscribed_at")),
        "updated_at": F.when(signed, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*keys, *[v.alias(k) for k, v in out.items()])


def unsubscribe(alerts: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Deactivate active alerts whose token was used."""
    used = tokens.filter(F.length("unsubscribe_token").between(20, 128)).select(
        "unsubscribe_token").distinct().withColumn("_hit", F.lit(True))
    rows = alerts.join(used, "unsubscribe_token", "left")
    hit = F.coalesce(F.col("_hit") & F.col("active"), F.lit(False))
    return rows.select(
        *[
            F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "active"
            else F.when(hit, now).otherwise(F.col(c)).alias(c) if c in ("unsubscribed_at", "updated_at")
            else F.col(c)
            for c in alerts.columns
        ]
    )


def fill_tokens(alerts: DataFrame, salt: str, key=("email", "category", "location")) -> DataFrame:
    """Give rows without a token one that cannot be guessed without the salt."""
    made = F.sha2(F.concat_ws("|", *[F.col(k) for k in key], F.lit(salt)), 256)
    token = F.coalesce(F.nullif(F.col("unsubscribe_token"), F.lit("")), made)
    return alerts.withColumn("unsubscribe_token", token)


def save_jobs(saved: DataFrame, incoming: DataFrame, jobs: DataFrame) -> DataFrame:
    """Insert bookmarks that are not there yet, for listings that exist."""
    keys = ["user_id", "job_id"]
    first = incoming.groupBy(*keys).agg(F.min("created_at").alias("created_at"))
    new = first.join(saved.select(*keys), keys, "left_anti").join(
        jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi"
    )
    return saved.select(*keys, "created_at").unionByName(new.select(*keys, "created_at"))


def unsave(saved: DataFrame, keys: DataFrame) -> DataFrame:
    return saved.join(keys.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def toggle(df: DataFrame, ids: DataFrame, flag: str, key: str = "id") -> DataFrame:
    """Flip a boolean once per listed id, so a pair of requests cancels out."""
    odd = ids.groupBy(key).agg((F.count("*") % 2 == 1).alias("_flip"))
    return df.join(odd, key, "left").withColumn(
        flag, F.when(F.coalesce("_flip", F.lit(False)), ~F.col(flag)).otherwise(F.col(flag))
    ).select(*df.columns)


def apply_edits(df: DataFrame, edits: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Full-row edits: the last edit of a row replaces all edited columns, unknown ids are added."""
    columns = [c for c in edits.columns if c in df.columns and c != key]
    last = edits.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("e"))
    joined = df.join(last, key, "full_outer")
    edited = F.col("e").isNotNull()
    return joined.select(
        *[
            F.when(edited, F.col("e")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def changed_urls(actions: DataFrame, base: str) -> DataFrame:
    """Public URLs of inserted and updated listings, each once."""
    url = public_url(F.concat(F.lit("/job/"), F.col("id").cast("string"), F.lit("/"), slug(F.col("title"))), base)
    return (
        actions.filter(F.col("action").isin("inserted", "updated"))
        .select(url.alias("url")).filter("url is not null").distinct()
    )
