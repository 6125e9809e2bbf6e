"""Exact de-duplication: a stream that keeps digest, stable identifier and content locator of every text in keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, work_dir
from .common import SPACES, stored

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    # one bound for the memory of all state partitions of an executor; the rest of the state is on disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small state partitions would otherwise each reserve megabytes of disk ahead of use
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; a null text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _entries(rows: DataFrame, digest) -> DataFrame:
    """digest, text_sha256, and the sort key of the copy that stays: more code points, then the smaller id, then the earlier place."""
    plain = normalised(F.col("text"))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    copy = F.struct((-length).alias("minus_length"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), place.alias("place"))
    return rows.select(digest(plain).alias("digest"), sha256(plain).alias("text_sha256"), copy.alias("copy"))


def stream_state(spark: SparkSession, path: str, schema: T.StructType, digest=sha256, files_per_batch: int = 1000) -> DataFrame:
    """Run the stream over the Parquet files at ``path`` to their end; (digest, best copy, group_size) as last updated.

    The state has one entry a digest and never expires: the digest, the stable id of the best copy, the locator of its
    content (file and row) and the number of copies. It lies in RocksDB on the executors' disks and, with every
    micro-batch, in the checkpoint in the shared folder, from which a lost executor's part is loaded elsewhere. Copies
    are combined inside each task before rows meet by digest, so a text that a third of the rows share is no hot key.
    Each micro-batch writes the entries it changed under its own number; a repeated batch overwrites its own folder.
    """
    # as a pattern, the path may be one file as well as a folder of files
    either = f"{path[:-1]}[{path[-1]}]"
    folder = f"{work_dir(spark).rstrip('/')}/exact-dedup-{uuid.uuid4().hex}"
    kept = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        entries = _entries(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(either), digest)
        groups = entries.groupBy("digest").agg(F.min("copy").alias("best"), F.count(F.lit(1)).alias("group_size"))

        def store(changed: DataFrame, number: int) -> None:
            changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

        query = groups.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = T.StructType([*groups.schema.fields, T.StructField("batch", T.IntegerType())])
    changes = spark.read.schema(shape).parquet(f"{folder}/changes")
    changes.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max_by("group_size", "batch").alias("group_size")).write.parquet(f"{folder}/groups")
    return spark.read.schema(groups.schema).parquet(f"{folder}/groups")


def dedup(spark: SparkSession, path: str, digest=sha256, files_per_batch: int = 1000) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their white-space-free forms are; a null text is the empty one. Of equal texts the one with
    most code points stays, then the smallest doc_id (null last), then the earliest place in the table, so exactly one
    row of a group is kept even when rows repeat whole. Other columns aren't read; an empty table gives no rows.

    A hit is a row whose digest the state holds for another row. Its full bytes are compared with those of the content
    that the locator points to. Rows that differ though their digests agree leave the group and are grouped among
    themselves by their bytes, so the answer doesn't rest on the digest.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = spark.read.schema(schema).parquet(path)
    state = stream_state(spark, path, schema, digest, files_per_batch)
    # these narrow rows are read several times, the texts they come from only once more, for hits
    joined = stored(_entries(docs, digest)).join(state, "digest").withColumn("place", F.col("copy.place"))
    hits = joined.where((F.col("group_size") > 1) & (F.col("place") != F.col("best.place")))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    content = docs.select(place.alias("place"), normalised(F.col("text")).alias("bytes"))
    seen = hits.select("digest", "text_sha256", "copy", "place", F.col("best.place").alias("of")).join(content, "place")
    held = state.where(F.col("group_size") > 1).select(F.col("best.place").alias("place")).join(content, "place").select(F.col("place").alias("of"), F.col("bytes").alias("held"))
    strangers = cut_lineage(seen.join(held, "of").where(F.col("bytes") != F.col("held")).select("digest", "text_sha256", "copy", "place", "bytes"))
    if strangers.isEmpty():
        return _answer(joined)
    apart = strangers.groupBy("digest", "bytes").agg(F.min("copy").alias("best"), F.count(F.lit(1)).alias("group_size"))
    fewer = strangers.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    rest = joined.join(strangers.select("place"), "place", "left_anti").join(fewer, "digest", "left")
    rest = rest.withColumn("group_size", F.col("group_size") - F.coalesce(F.col("gone"), F.lit(0)))
    return _answer(rest).unionByName(_answer(strangers.join(apart, ["digest", "bytes"])))


def _answer(rows: DataFrame) -> DataFrame:
    kept = F.col("place") == F.col("best.place")
    return rows.select(F.col("copy.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
