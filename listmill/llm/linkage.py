"""Links and connected groups from candidate lists, without pairing up the members of a list.

A *list* is all nodes that share a token. Only pairs that share a list can be links; whether a pair is one is decided by
the caller. Groups are wanted, not pairs, and that allows the work to stay near linear in the length of a list:

1. every node is paired with the smallest node of each of its lists. Of these pairs, each node's first is verified;
2. then those of the other star pairs whose ends aren't in one group yet;
3. last, in lists that still touch several groups, the pairs across groups. A pair inside a group can't change it.

Pairs are asked about only if they share as many lists as a link must. Steps 1 and 2 count the lists with the smallest
node as one end, step 3 all of them, so what the first two pass over comes up in the third.

Every pair that shares a list is thus verified, or skipped because both ends are in one group already, or ruled out by
the caller's cheap bound; no list, however long, is cut. Everything is joins, windows and grouping by Spark; long groups
spill and hot keys of joins may be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the ends of ``edges`` (a, b): label is the smallest node of the connected group.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones, are hung on its
    smallest neighbour. Stars of any size collapse at once and chains halve; each round is grouping and one join.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    size = _mark(now)
    few = tasks_for(now, size[0])
    now = now.coalesce(few)
    while size[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        near = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m")).coalesce(few)
        large = both.join(near, "v").coalesce(few).where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(near.where(F.col("m") < F.col("v")).select("v", F.col("m").alias("u"))).where(F.col("v") != F.col("u")).distinct().coalesce(few)
        least = large.groupBy("v").agg(F.min("u").alias("m")).coalesce(few)
        small = large.join(least, "v").coalesce(few).select(F.col("u").alias("v"), F.col("m").alias("u")).where(F.col("v") != F.col("u"))
        new = stored(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct().coalesce(few))
        after = _mark(new)
        now = new
        if after == size:
            break
        size = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for narrow rows: one for every quarter of a million, and at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // 250_000 + 1)


def _mark(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return got.n, int(got.h)


def groups(
    postings: DataFrame,
    nodes: DataFrame,
    may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verifier: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    quick: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    lists: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] = lambda x, y: F.lit(1),
) -> DataFrame:
    """(node, label) of all nodes in a group of two or more.

    postings: (token, node) and the columns that ``quick`` reads, repeated rows allowed. nodes: one row a node, ``node``
    and the columns ``may_link`` and ``lists`` read.
    may_link(x, y): a condition that holds for every link; x and y give the columns of either end.
    quick: such a condition too, on what the postings carry; star pairs that fail it aren't looked at further.
    lists: the least number of lists that the ends of a link share.
    verifier: gets all pairs (a, b) that may be asked about and returns the function from some of them to the links.
    """
    carried = [c for c in postings.columns if c not in ("token", "node")]
    least = F.min(F.struct("node", *carried)).over(Window.partitionBy("token"))
    listed = postings.withColumn("least", least).where(F.col("node") != F.col("least.node"))
    able = quick(lambda c: F.col(f"least.{c}"), F.col)
    star = stored(listed.select("token", "node", F.col("least.node").alias("pivot"), able.alias("able")).distinct())
    attributes = [c for c in nodes.columns if c != "node"]

    def end(side: str) -> DataFrame:
        return nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in attributes])

    ends = lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")
    bound, least_lists = may_link(*ends), lists(*ends).alias("least_lists")
    pairs = star.where("able").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = stored(pairs.join(end("b"), "b").join(end("a"), "a").where(bound).select("a", "b", "shared", least_lists))
    few = tasks_for(pairs, pairs.count())
    pairs = pairs.coalesce(few)
    likely = pairs.where("shared >= least_lists").select("a", "b", "shared")
    verify = verifier(likely)
    first = likely.groupBy("b").agg(F.max_by("a", F.struct("shared", F.bitwise_not("a"))).alias("a")).select("a", "b")
    links = stored(verify(first).coalesce(few))
    labels = components(links)
    more = stored(verify(_apart(likely, labels).coalesce(few)).coalesce(few))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    members = star.select("token", "node").unionByName(star.select("token", F.col("pivot").alias("node")).distinct())
    members = members.join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    mixed = members.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("pivot")).where(F.col("low") != F.col("high"))
    # a list of two has no pair beside its star pair
    longer = mixed.join(star.groupBy("token").count().where(F.col("count") > 1).select("token"), "token", "left_semi").select("token", "pivot")
    open_ = stored(members.join(longer, "token").where(F.col("node") != F.col("pivot")).join(nodes, "node"))
    side = lambda s: open_.select("token", F.col("node").alias(s), F.col("label").alias(f"{s}_label"), *[F.col(c).alias(f"{s}_{c}") for c in attributes])
    beside = (
        side("a").join(side("b"), "token")
        .where((F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label")) & bound).select("a", "b", F.lit(1).cast("long").alias("shared"), least_lists)
    )
    counted = beside.unionByName(_apart(pairs, labels)).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least_lists").alias("least_lists"))
    across = stored(counted.where("shared >= least_lists").select("a", "b"))
    if across.isEmpty():
        return labels
    rest = stored(verifier(across)(across))
    return labels if rest.isEmpty() else components(links.unionByName(rest))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one group."""
    with_a = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    with_b = with_a.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    return with_b.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)
