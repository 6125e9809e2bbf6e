"""Readers and writers of the stored tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def read_sources(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """Source registry (JSON array): typed, defaults filled, disabled sources dropped."""
    df = spark.read.schema(S.SOURCES).option("multiLine", True).json(path)
    empty = F.array().cast("array<string>")
    df = df.select(
        F.col("name").alias("source_name"),
        F.coalesce("type", F.lit("generic")).alias("type"),
        F.coalesce("start_urls", empty).alias("start_urls"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("max_pages", F.lit(1)).alias("max_pages"),
        F.coalesce("max_detail_pages", F.lit(40)).alias("max_detail"),
        F.coalesce("default_location", F.lit("Zimbabwe")).alias("default_location"),
        F.coalesce("default_category", F.lit("Other")).alias("default_category"),
        "default_company",
        F.coalesce("allowed_locations", empty).alias("allowed_locations"),
        F.coalesce("skip_expired", F.lit(True)).alias("skip_expired"),
        F.coalesce("pagination_strategy", F.lit("auto")).alias("pagination_strategy"),
        "selectors",
        F.coalesce("include_url_patterns", empty).alias("include_url_patterns"),
        F.coalesce("exclude_url_patterns", empty).alias("exclude_url_patterns"),
        F.coalesce("allow_external_detail_urls", F.lit(False)).alias("allow_external"),
    )
    return df.filter("enabled") if enabled_only else df


def link_rules(sources: DataFrame) -> DataFrame:
    """Per-source link settings in the form ``detail_links`` joins with."""
    either = lambda c: F.nullif(F.array_join(c, "|"), F.lit(""))
    return sources.select(
        "source_name", either("include_url_patterns").alias("include_pattern"),
        either("exclude_url_patterns").alias("exclude_pattern"),
        F.lit(None).cast("string").alias("only_pattern"), "allow_external",
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: page_id, url, html."""
    return spark.read.schema("page_id bigint, url string, html string").parquet(path)


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns a table lacks, as nulls, and cast the others; order as in the schema."""
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_jobs(spark: SparkSession, *paths: str) -> DataFrame:
    """Listings of one or more snapshots that may lack optional columns."""
    out = None
    for p in paths:
        df = evolve(spark.read.parquet(p), S.JOBS)
        out = df if out is None else out.unionByName(df)
    return out


def append(df: DataFrame, target_columns, path: str) -> None:
    """Append only the columns the target has."""
    df.select(*[c for c in target_columns if c in df.columns]).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """A new snapshot in its own folder, so that readers of the old one are not disturbed."""
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def rebuild(spark: SparkSession, current: dict[str, str], fresh: DataFrame, root: str):
    """Back up listings and dependent tables, then start over from ``fresh``.

    ``current``: table name to path, with "jobs" among them. Gives the new paths, the backup
    paths and a frame of row counts before and after.
    """
    counts, backup, paths = None, {}, {}
    for name, path in current.items():
        before = spark.read.parquet(path)
        backup[name] = write_snapshot(before, root, f"backup-{name}")
        after = fresh if name == "jobs" else before.limit(0)
        paths[name] = write_snapshot(after, root, name)
        row = before.agg(F.count("*").alias("before")).withColumn("after", spark.read.parquet(paths[name]).agg(F.count("*")).scalar())
        row = row.select(F.lit(name).alias("table_name"), "before", "after")
        counts = row if counts is None else counts.unionByName(row)
    return paths, backup, counts
