"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, aside, numbered

# Fixed values of the contract: weights repeat over the ordered sources, and no source is taken more than so many times.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3

# hexadecimal digits of the order by which a source is divided
_PREFIX = 3
# a word and the white space before it: side by side they are the text up to the end of a word
_WITH_BLANKS = r"[\x20\x09-\x0D]*" + WORD


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, weigh ``weights`` in turn. All sources share the total; a source stops at
    ``max_epochs`` times its size and its excess goes to the others by weight, until none is above. That fixed point is
    min(cap, level * weight) with one level for all: sources are passed in the order of cap / weight, and the first
    prefix that leaves the rest under their caps gives the level. Only the table of sources is ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # the level left over after capping all sources before this one; it stands from the first source that it doesn't cap
    levels = per.withColumn("level", level).withColumn("place", F.row_number().over(by_cap)).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)["level"]
    return levels.select("source", "source_size", F.when(F.col("free"), first * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, text_hash, size, source_size, target and taken.

    ``taken`` counts the words that the mix takes of the document: its whole size for every whole repetition of the
    source, and for the fractional one its whole size again if it comes early enough in the seeded order of the source;
    the one document that crosses the end of the fraction gives only the words still missing. Taken words of a source
    therefore add up to its rounded target.

    The order is by md5 of seed and doc_id. Sizes are added up by the first hexadecimal digits of that hash, so only
    the documents of the one group in which a source's fraction ends are ordered among each other.

    Null and empty texts have size 0 and nothing taken; a null source is a source of its own, last in order; rows that
    repeat a doc_id are separate documents, settled by size and text hash; equal rows are alike. Other columns aren't read; no rows
    give no rows; a table without words has targets 0.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = cut_lineage(
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size_of(F.col("text")).alias("size"), key.alias("key")).withColumn("part", F.substring("key", 1, _PREFIX))
    )
    goal = targets(rows, weights, max_epochs).withColumn("whole", F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).cast("long"))
    goal = goal.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(so_far), F.lit(0)))
    g, p, r = goal.alias("g"), parts.alias("p"), rows.alias("r")
    parts = p.join(g, F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "g.source_size", "g.target", "g.whole", (F.col("rest") - F.col("before")).alias("left"))
    p = parts.alias("p")
    placed = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))).select(
        "r.*", "p.source_size", "p.target", "p.whole", "p.left", F.col("p.part_size")
    )
    full, none = F.col("left") >= F.col("part_size"), F.col("left") <= 0
    extra = F.when(full, F.col("size")).otherwise(F.lit(0).cast("long"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(~full & ~none).withColumn("gone", F.coalesce(F.sum("size").over(within), F.lit(0)))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("gone"))))
    out = placed.where(full | none).withColumn("extra", extra).unionByName(edge.drop("gone"))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: every row as often as the mix takes it whole, and once
    more only up to the end of its last word taken where a source's fraction ends inside it. That part is the text as it
    stands, line breaks and blanks included; the words after it are beyond the target and stay out."""
    taken = mix(docs, weights, max_epochs, seed).groupBy("doc_id", "source", "text_hash").agg(
        F.first("size").alias("__size"), F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__rows")
    )
    taken = taken.where(F.col("__taken") > 0).withColumnsRenamed({"doc_id": "__id", "source": "__source", "text_hash": "__of"})
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__hash") == F.col("__of"))
    given, back = aside(docs, "doc_id", "source", "text", "n_chars")
    rows = numbered(given).join(taken, match)
    # equal rows share what was taken of them: whole repetitions alike, the rest in the order of their numbers
    whole = F.floor(F.col("__taken") / (F.col("__size") * F.col("__rows")))
    rest = F.col("__taken") - whole * F.col("__size") * F.col("__rows") - (F.col("__copy") - 1) * F.col("__size")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest)).cast("int")
    times = F.when(whole > 0, F.sequence(F.lit(1).cast("long"), whole)).otherwise(F.array().cast("array<long>"))
    times = F.when(part > 0, F.concat(times, F.array(F.lit(0).cast("long")))).otherwise(times)
    out = rows.withColumn("__part", part).withColumn("__time", F.explode(times))
    cut = (F.col("__time") == 0) & (F.col("__part") < F.col("__size"))
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WITH_BLANKS), 0), F.lit(1), F.greatest(F.lit(1), F.col("__part"))), "")
    text = F.when(cut, start).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return back(out)
