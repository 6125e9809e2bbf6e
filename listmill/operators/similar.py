"""The k most similar listings of every listing, exactly, without meeting all pairs.

A score has a fixed part, which depends on a listing's profile (attributes, title words, tags,
places), and a part from shared text words that is bounded. Bounds prune: a candidate is looked
at only if its fixed part and the most that text can add beat the base's k-th best so far.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab as V
from ..functions.quality import is_public
from ..functions.text import empty_if_null, keywords, tag_keys
from ..session import cut_lineage

W = V.SIMILAR_WEIGHTS
_CELL = ("category", "employment_type", "remote_status", "experience_level")
# listings that agree in all of these are tried first; they give each base its first bound
POOLS = [(*_CELL, "title_w", "tag_w"), ("category", "title_w", "tag_w"), ("title_w", "tag_w"), (*_CELL, "title_w"), (*_CELL, "tag_w"), ("category", "title_w"), _CELL]
HEADS = 8           # rows of a profile that are looked at before its text postings are
FIRST = 12          # candidates by fixed part that are looked at before bounds prune the rest


def _features(df: DataFrame) -> DataFrame:
    get = lambda n: F.col(n) if n in df.columns else F.lit("")
    profile = F.struct(
        "category",
        *[empty_if_null(get(n)).alias(n) for n in ("employment_type", "remote_status", "experience_level")],
        F.array_contains(keywords(F.col("category")), "remote").alias("remote_cat"),
        F.array_sort(keywords(get("title"))).alias("title_w"),
        F.array_sort(tag_keys(get("tags"))).alias("tag_w"),
        F.array_sort(keywords(get("location"))).alias("place_w"),
    )
    words = keywords(*[get(n) for n in ("summary", "job_description", "requirements", "department")])
    return df.select(
        "id", "is_base", "is_candidate", F.struct("featured", "created_at", "id").alias("tie"), profile.alias("p"),
        # 64-bit hashes stand for words: a few bytes each where pairs are compared
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    ).withColumn("pid", F.md5(F.to_json("p")))


def fixed_score(a: Column, b: Column) -> Column:
    """The part of the score that two profiles decide."""
    both = lambda n: F.size(F.array_intersect(a[n], b[n]))
    same = lambda n: F.when((a[n] != "") & (a[n] == b[n]), W[n]).otherwise(0)
    category = F.when(a["category"] == b["category"], W["category"]).when(a["remote_cat"] & b["remote_cat"], W["remote_cat"]).otherwise(0)
    return (
        category + same("employment_type") + same("remote_status") + same("experience_level")
        + both("title_w") * W["title"] + both("tag_w") * W["tag"] + F.least(both("place_w"), F.lit(W["place_max"])) * W["place"]
    )


def text_bonus(n: Column) -> Column:
    return F.least(n, F.lit(W["text_max"])) * W["text"]


def _tokens(p: Column) -> Column:
    """What a profile can share with another, each with the score that is lost without it. Places aren't listed."""
    token = lambda kind, value, weight: F.struct(F.concat(F.lit(kind), value).alias("token"), F.lit(weight).alias("w"))
    some = lambda cond, t: F.when(cond, t)
    of_category = F.when(p["remote_cat"], W["category"] - W["remote_cat"]).otherwise(W["category"])
    single = F.array_compact(
        F.array(
            some(p["category"].isNotNull(), F.struct(F.concat(F.lit("c:"), p["category"]).alias("token"), of_category.alias("w"))),
            some(p["remote_cat"], token("rc", F.lit(""), W["remote_cat"])),
            *[some(p[n] != "", token(f"{n}:", p[n], W[n])) for n in ("employment_type", "remote_status", "experience_level")],
        )
    )
    listed = lambda name, kind, weight: F.transform(p[name], lambda x: token(kind, x, weight))
    return F.concat(single, listed("title_w", "t:", W["title"]), listed("tag_w", "g:", W["tag"]))


def _best(rows: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def _pools(heads: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """(pid, candidate, q, fixed, tie): for every base's profile the k best rows, by fixed part, of its pools."""
    digests = F.array(*[F.md5(F.to_json(F.struct(F.lit(i).alias("i"), *[F.col("p")[c].alias(c) for c in names]))) for i, names in enumerate(POOLS)])
    rows = heads.join(profiles.select(F.col("pid").alias("q"), "p"), "q").select("candidate", "q", "tie", F.explode(digests).alias("pool"))
    pools = _best(rows, "pool", k, "tie")
    asked = profiles.filter("is_base").select("pid", F.explode(digests).alias("pool"))
    # k rows go with every profile: the fill of bases without common words
    newest = heads.orderBy(F.desc("tie")).limit(k).agg(F.collect_list(F.struct("candidate", "q", "tie")).alias("rows")).scalar()
    fill = profiles.filter("is_base").select("pid", F.explode(newest).alias("n")).select("pid", "n.*")
    met = asked.join(pools, "pool").select("pid", "candidate", "q", "tie").unionByName(fill).distinct()
    return _best(_with_fixed(met, profiles), "pid", k, "fixed", "tie")


def _with_fixed(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    side = lambda key, name: profiles.select(F.col("pid").alias(key), F.col("p").alias(name))
    both = pairs.join(side("pid", "a"), "pid").join(side("q", "b"), "q")
    return both.withColumn("fixed", fixed_score(F.col("a"), F.col("b"))).drop("a", "b")


def _scored(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """(id, candidate, score, tie) of pairs (id, candidate, fixed, tie), with the words that the two texts share."""
    side = lambda key, name: feats.select(F.col("id").alias(key), F.col("words").alias(name))
    both = pairs.filter("id <> candidate").join(side("candidate", "y"), "candidate").join(side("id", "x"), "id")
    score = F.col("fixed") + text_bonus(F.size(F.array_intersect("x", "y")))
    return both.select("id", "candidate", score.cast("bigint").alias("score"), "tie")


def _kth(done: DataFrame, bases: DataFrame, k: int) -> DataFrame:
    """Bases with ``least``: (score, tie) of the k-th best looked at so far, null where fewer were."""
    best = _best(done, "id", k, "score", "tie").groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("score", "tie")).alias("least"))
    return bases.join(best.filter(F.col("n") == k).drop("n"), "id", "left")


def _beats(fixed: Column) -> Column:
    """Whether a row with this fixed part and its own tie could come before the base's k-th best."""
    most = F.struct((fixed + F.col("ub")).cast("bigint").alias("score"), F.col("tie").alias("tie"))
    return F.col("least").isNull() | (most > F.col("least"))


def _by_prefix(profiles: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, q, fixed) of all profile pairs whose fixed part reaches the base profile's need, and profiles left to do.

    A candidate that reaches the need misses tokens of at most ``slack`` together. Tokens are ordered by rarity; as soon
    as those taken weigh more than the slack, every candidate shares one of them, and only their postings are read.
    """
    tokens = profiles.select("pid", "is_base", "n_rows", F.explode(_tokens(F.col("p"))).alias("t")).select("pid", "is_base", "n_rows", "t.token", "t.w")
    postings = tokens.filter("n_rows > 0").select("token", F.col("pid").alias("q"))
    counts = postings.groupBy("token").agg(F.count("*").alias("df"))
    places = F.least(F.size("p.place_w"), F.lit(W["place_max"])) * W["place"]
    most = F.aggregate(_tokens(F.col("p")), F.lit(0), lambda s, t: s + t["w"])
    slack = profiles.join(needs, "pid").select("pid", "need", most.alias("most"), (most + places - F.col("need")).alias("slack"))
    mine = tokens.filter("is_base").join(counts, "token", "left").join(slack.filter("most > slack"), "pid")
    before = Window.partitionBy("pid").orderBy(F.coalesce("df", F.lit(0)), "token").rowsBetween(Window.unboundedPreceding, -1)
    prefix = mine.withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0))).filter("gone <= slack").select("pid", "token", "need")
    met = prefix.join(postings, "token").select("pid", "q", "need").distinct()
    return _with_fixed(met, profiles).filter("fixed >= need").select("pid", "q", "fixed"), slack.filter("most <= slack").select("pid")


def _lonely(feats: DataFrame, profiles: DataFrame, bases: DataFrame) -> DataFrame:
    """(id, candidate, fixed, tie) of all rows that share anything with bases whose bound rules nothing out."""
    tokens = F.concat(
        F.transform(_tokens(F.col("p")), lambda t: t["token"]), F.transform(F.col("p.place_w"), lambda w: F.concat(F.lit("p:"), w)),
        F.transform("words", lambda w: F.concat(F.lit("x:"), w.cast("string"))),
    )
    asked = feats.join(bases.select("id"), "id", "left_semi").select("id", "pid", F.explode(tokens).alias("token"))
    have = feats.filter("is_candidate").select(F.col("id").alias("candidate"), F.col("pid").alias("q"), "tie", F.explode(tokens).alias("token"))
    met = asked.join(have, "token").select("id", "pid", "candidate", "q", "tie").distinct()
    return _with_fixed(met, profiles).select("id", "candidate", "fixed", "tie")


def _by_words(left: DataFrame, feats: DataFrame) -> DataFrame:
    """(id, candidate, fixed, tie): rows beyond the heads of large profiles that share words enough to matter.

    ``left`` has (id, q, fixed, least). A row must share c words with the base, so it holds one of any n - c + 1 of the
    base's n words; the rarest of the profile are asked for.
    """
    c = F.greatest(F.lit(1), F.ceil((F.coalesce(F.col("least.score"), F.lit(0)) - F.col("fixed")) / W["text"]))
    rows = feats.filter("is_candidate").select(F.col("id").alias("candidate"), F.col("pid").alias("q"), "tie", F.explode("words").alias("word"))
    postings = rows.join(left.select("q").distinct(), "q", "left_semi")
    counts = postings.groupBy("q", "word").agg(F.count("*").alias("df"))
    own = left.join(feats.select("id", "words"), "id").select("id", "q", "fixed", (F.size("words") - c + 1).alias("take"), F.explode("words").alias("word"))
    rarest = Window.partitionBy("id", "q").orderBy(F.coalesce("df", F.lit(0)), "word")
    asked = own.join(counts, ["q", "word"], "left").withColumn("n", F.row_number().over(rarest)).filter("n <= take")
    return asked.select("id", "q", "fixed", "word").join(postings, ["q", "word"]).select("id", "candidate", "fixed", "tie").distinct()


def similar(jobs: DataFrame, bases: DataFrame, as_of_date: Column, k: int = V.SIMILAR_LIMIT, public_only: bool = True) -> DataFrame:
    """id, candidate_id, score, rank: the k most similar other listings of each base listing (``bases``: ids).

    Rank is by score, featured, creation time and id. A base with fewer than k scored listings is filled by the newest.
    The result is exact: pools of equal profiles give each base a first k-th best; postings of the rarest profile tokens
    find every profile that could still beat it; rows of those profiles are looked at in order of their bound, and what
    is left of large profiles through postings of text words. Work follows the candidates that survive, not the square.
    """
    shown = F.coalesce(is_public(jobs, as_of_date), F.lit(False)) if public_only else F.lit(True)
    asked = bases.select("id").distinct().withColumn("is_base", F.lit(True))
    rows = jobs.withColumn("is_candidate", shown).join(asked, "id", "left").withColumn("is_base", F.coalesce("is_base", F.lit(False)))
    whole = cut_lineage(_features(rows).filter("is_base or is_candidate"))
    feats = whole.drop("p")
    profiles = cut_lineage(whole.groupBy("pid").agg(F.first("p").alias("p"), F.max("is_base").alias("is_base"), F.count_if("is_candidate").alias("n_rows")))
    candidates = feats.filter("is_candidate").select(F.col("id").alias("candidate"), F.col("pid").alias("q"), "tie")
    heads = cut_lineage(_best(candidates, "q", max(HEADS, 2 * k + 1), "tie"))
    ub = text_bonus(F.size("words"))
    viewed = cut_lineage(feats.filter("is_base").select("id", "pid", ub.alias("ub")))

    def look(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
        new = pairs if done is None else pairs.join(done.select("id", "candidate"), ["id", "candidate"], "left_anti")
        seen = _scored(new, feats)
        # of what was looked at, the k best are enough to go on
        return cut_lineage(_best(seen if done is None else done.unionByName(seen), "id", k, "score", "tie"))

    near = _pools(heads, profiles, 2 * k + 1)
    done = look(viewed.join(near, "pid").select("id", "candidate", "fixed", "tie"), None)
    bound = _kth(done, viewed, k)
    needs = bound.groupBy("pid").agg(F.min(F.coalesce(F.col("least.score"), F.lit(0)) - F.col("ub")).alias("need"))
    pairs, alone = (cut_lineage(df) for df in _by_prefix(profiles, needs))
    if not alone.isEmpty():
        done = look(_lonely(whole, profiles, viewed.join(alone, "pid", "left_semi")), done)

    reached = pairs.join(heads, "q")
    first = _best(reached, "pid", FIRST, "fixed", "tie").select("pid", "candidate", "fixed", "tie")
    done = look(viewed.join(first, "pid").select("id", "candidate", "fixed", "tie"), done)
    bound = cut_lineage(_kth(done, viewed, k))
    could = bound.join(pairs, "pid").filter(F.col("least").isNull() | (F.col("fixed") + F.col("ub") >= F.col("least.score")))
    done = look(could.join(heads, "q").filter(_beats(F.col("fixed"))).select("id", "candidate", "fixed", "tie"), done)

    # profiles with more rows than their heads: the last head bounds the ties of the rest
    large = profiles.filter(F.col("n_rows") > max(HEADS, 2 * k + 1)).select(F.col("pid").alias("q"))
    lowest = heads.join(large, "q", "left_semi").groupBy("q").agg(F.min("tie").alias("tie"))
    left = cut_lineage(_kth(done, viewed, k).join(pairs, "pid").join(lowest, "q").filter(_beats(F.col("fixed"))).select("id", "q", "fixed", "least"))
    if not left.isEmpty():
        done = look(_by_words(left, feats), done)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.desc("tie")))
    return done.select("id", F.col("candidate").alias("candidate_id"), "score", rank.alias("rank")).filter(F.col("rank") <= k)
