"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path

# Fixed values of the contracts: ASCII white space, and words as runs of anything else (Java and Python syntax alike).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of ``rows``, those whose hashed key comes first: the same rows at every run and partitioning.

    Keys are picked from the key column alone, so the wide columns are read for the sample only; the picked keys are
    at most ``n`` and may therefore be broadcast. Rows with a null key are never picked. For rows to collect: the limit
    holds even where keys repeat.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    keys = rows.select(key).where(F.col(key).isNotNull()).orderBy(order, F.col(key)).limit(n).distinct()
    return rows.join(F.broadcast(keys), key, "left_semi").limit(n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, folds: int, held: int, seed: int = 0) -> DataFrame:
    """(doc_id, text, y) of at most ``n`` training documents: labelled 0 or 1 and outside the held-out remainder.

    A document labelled more than once counts with its highest label; null labels are left out. Rows that repeat a
    picked doc_id all come along, so callers that collect set a limit.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    picked = known.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(n)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def byte_ngrams(data: np.ndarray, order: int, bits: int, salt: int = 0) -> np.ndarray:
    """Bucket of every window of ``order`` bytes (uint8 input), by a multiplicative hash of ``bits`` bits."""
    m = len(data) - order + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.full(m, (2166136261 + 97 * order + salt) & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h ^= data[k : k + m]
        h *= np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of the public splitmix64 generator)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of UTF-8 bytes, words being runs without ASCII white space.

    The hash is 64 bits wide: the word's bytes times a random multiplier for each place, added up and scrambled.
    """
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(solid)
    begins = (np.cumsum(solid) - 1)[starts]
    lengths = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    factors = mix64(np.arange(int(lengths.max()), dtype=np.uint64)) | np.uint64(1)
    sums = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * factors[place], begins)
    return mix64(sums ^ (lengths.astype(np.uint64) << np.uint64(40))), starts


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lost executors cost no recomputation, and joins on the
    result are planned (and split, where a key is hot) from its real sizes."""
    path = fresh_path(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SIEVE_BITS = 20


def sieve(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of ``rows`` that may have their key among ``wanted``: all that do, and few others while ``wanted`` is small.

    A bitmap of 2**SIEVE_BITS hash slots (128 KB, whatever the input) goes with the scan, so that wide rows which no
    one wants aren't shuffled for the exact join that follows.
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << SIEVE_BITS)).cast("int")
    marks = wanted.select(slot(wanted_key).alias("s")).groupBy(F.shiftright("s", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, s % 64)")).alias("bits"))
    words = [0] * (1 << SIEVE_BITS - 6)
    for r in marks.collect():
        words[r.i] = r.bits
    bitmap = F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<long>")
    return rows.where(F.getbit(F.get(bitmap, F.shiftright(slot(key), 6)), slot(key) % 64) == 1)


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with every column but ``own`` renamed, so that none clashes with an operator's own columns, and the
    function that gives a result its first names and order back, any further columns named to it last."""
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in own}

    def back(out: DataFrame, *more: str) -> DataFrame:
        return out.select(*[F.col(others[c]).alias(c) if c in others else F.col(c) for c in docs.columns], *more)

    return docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns]), back


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__hash`` of the text and ``__copy``, the number of a row among those with its doc_id and text.

    Where no row repeats another, which a narrow grouping tells, every number is 1 and the texts needn't be shuffled.
    """
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    if hashed.groupBy("doc_id", "__hash").count().where(F.col("count") > 1).isEmpty():
        return hashed.withColumn("__copy", F.lit(1))
    return hashed.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy(F.lit(0))))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand Python ``rows`` rows at a time, which bounds a worker's memory where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
