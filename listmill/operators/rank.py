"""Offer ranking."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab as V
from ..functions.text import delimited_set, empty_if_null

def _profile(category: Column, text: Column) -> dict:
    """What of a listing an offer's score depends on: its category and the keyword rules it meets."""
    low = F.lower(text)
    met = reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.when(low.rlike("|".join(words)), F.lit(1 << i)).otherwise(F.lit(0))
            for i, (_, words, _) in enumerate(V.OFFER_KEYWORD_BONUS)
        ],
    )
    return {"job_category": F.lower(empty_if_null(category)), "met": met}


def _keyword_bonus(offer_category: Column, met: Column) -> Column:
    col = None
    for i, (cats, _, points) in enumerate(V.OFFER_KEYWORD_BONUS):
        cond = offer_category.isin(cats) & (met.bitwiseAND(1 << i) > 0)
        col = F.when(cond, points) if col is None else col.when(cond, points)
    return col.otherwise(0)


def keyword_bonus(offer_category: Column, text: Column) -> Column:
    return _keyword_bonus(offer_category, _profile(F.lit(""), text)["met"])


def eligible_offers(offers: DataFrame, audience: str, placement: str, offer_categories=None) -> DataFrame:
    cond = F.col("is_active") & F.array_contains(delimited_set(F.col("placement_locations")), placement.lower())
    if audience:
        cond = cond & F.array_contains(delimited_set(F.col("audience_type")), audience.lower())
    if offer_categories:
        cond = cond & F.col("offer_category").isin(list(offer_categories))
    return offers.filter(cond)


def rank_offers(
    jobs: DataFrame, offers: DataFrame, audience="job_seeker", placement="job_detail", k=2,
    offer_categories=None, query="",
) -> DataFrame:
    """The k best offers of every listing; one per offer category when there are more than k.

    An offer's score depends on a listing only through its profile (category and keyword
    rules met). So offers are first reduced to the best of each (offer category, target),
    then ranked per distinct profile, and listings look their profile up by an equi-join.
    Listings and offers never meet pair by pair.
    """
    pool = eligible_offers(offers, audience, placement, offer_categories).select(
        "id", "offer_category", F.coalesce("priority_score", F.lit(0)).alias("priority"),
        delimited_set(F.col("job_category_targets")).alias("targets"),
    )
    bonus_cats, bonus = V.DETAIL_PLACEMENT_BONUS
    placed = F.when(F.col("offer_category").isin(bonus_cats), bonus).otherwise(0) if placement == "job_detail" else F.lit(0)
    # how the offer scores for: a listing of a target category, any other one, one without category
    for_all = F.array_contains("targets", "all")
    entry = lambda key, points: F.struct(key.alias("target"), points.alias("points"))
    entries = F.when(
        for_all,
        F.array(entry(F.lit("*"), F.lit(8)), entry(F.lit(""), F.lit(8))),
    ).otherwise(
        F.concat(
            F.array(entry(F.lit("*"), F.lit(-18)), entry(F.lit(""), F.lit(0))),
            F.transform(F.filter("targets", lambda t: t != ""), lambda t: entry(t, F.lit(30))),
        )
    )
    per_target = pool.withColumn("e", F.explode(entries)).select(
        "offer_category", F.col("e.target").alias("target"),
        F.struct(
            (F.col("priority") + F.col("e.points") + placed).alias("base"), F.col("priority"), F.col("id")
        ).alias("o"),
    )
    pool_size = pool.agg(F.count("*")).scalar()
    best = Window.partitionBy("offer_category", "target").orderBy(F.desc("o"))
    # with a pool of at most k offers all of them stay; else the best of each category do
    heads = per_target.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).filter(
        (F.col("r") == 1) | (pool_size <= k)
    ).drop("r")

    text = F.concat_ws(
        " ",
        *[
            empty_if_null(F.col(n)) if n in jobs.columns else F.lit("")
            for n in ("title", "summary", "job_description", "requirements", "remote_status", "experience_level")
        ],
        F.lit(query),
    )
    prof = jobs.select("id", *[v.alias(n) for n, v in _profile(F.col("category"), text).items()])
    profiles = prof.select("job_category", "met").distinct()
    asked = profiles.withColumn(
        "target",
        F.explode(
            F.when(F.col("job_category") == "", F.array(F.lit(""))).otherwise(F.array(F.lit("*"), F.col("job_category")))
        ),
    )
    cand = asked.join(heads, "target")
    # a targeted offer is also listed under "*" with a lower score: keep its best entry
    cand = cand.groupBy("job_category", "met", "offer_category", F.col("o.id").alias("offer_id")).agg(
        F.max("o").alias("o")
    )
    cand = cand.withColumn("score", F.col("o.base") + _keyword_bonus(F.col("offer_category"), F.col("met")))
    order = [F.desc("score"), F.desc("o.priority"), F.desc("offer_id")]
    in_cat = Window.partitionBy("job_category", "met", "offer_category").orderBy(*order)
    overall = Window.partitionBy("job_category", "met").orderBy(*order)
    chosen = (
        cand.withColumn("c", F.row_number().over(in_cat))
        .filter((F.col("c") == 1) | (pool_size <= k))
        .withColumn("rank", F.row_number().over(overall))
        .filter(F.col("rank") <= k)
        .select("job_category", "met", "offer_id", "offer_category", "score", "rank")
    )
    return prof.join(chosen, ["job_category", "met"]).select("id", "rank", "offer_id", "offer_category", "score")
