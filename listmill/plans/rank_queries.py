"""Similar listings and offer ranking."""

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import rank as R
from ..operators.similar import similar
from . import adaptors as A
from . import duck as D
from .registry import query


def _set_sql(c):
    return f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '[,;|]'), lambda t: trim(t)), lambda t: t <> '')"


def _bonus_sql():
    cases = []
    for cats, words, points in V.OFFER_KEYWORD_BONUS:
        names = ", ".join(D.q(c) for c in cats)
        cases.append((f"o.offer_category IN ({names}) AND regexp_matches(j.hay, {D.q('|'.join(words))})", str(points)))
    return D.first_of(cases, "0")


def _offer_sql(placement, k):
    bonus_cats, bonus = V.DETAIL_PLACEMENT_BONUS
    placed = f"CASE WHEN o.offer_category IN ({', '.join(D.q(c) for c in bonus_cats)}) THEN {bonus} ELSE 0 END" if placement == "job_detail" else "0"
    return A.with_views(
        A.JOBS_SQL, A.OFFERS_SQL,
        f"pool AS (SELECT id, offer_category, priority_score, {_set_sql('job_category_targets')} AS targets FROM offers "
        f"WHERE is_active AND list_contains({_set_sql('placement_locations')}, '{placement}') AND list_contains({_set_sql('audience_type')}, 'job_seeker'))",
        "j AS (SELECT id, lower(category) AS cat, lower(title || ' ' || summary || ' ' || job_description || ' ' || coalesce(requirements, '') || ' ' || remote_status || ' ' || experience_level) AS hay FROM jobs)",
        f"s AS (SELECT j.id, o.id AS offer_id, o.offer_category, o.priority_score, o.priority_score + CASE WHEN list_contains(targets, 'all') THEN 8 WHEN list_contains(targets, j.cat) THEN 30 ELSE -18 END + {_bonus_sql()} + {placed} AS score FROM j, pool o)",
        "c AS (SELECT *, row_number() OVER (PARTITION BY id, offer_category ORDER BY score DESC, priority_score DESC, offer_id DESC) AS c FROM s)",
        f"r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, priority_score DESC, offer_id DESC) AS rank FROM c WHERE c = 1 OR (SELECT count(*) FROM pool) <= {k})",
    ) + f"SELECT id, rank, offer_id, offer_category, cast(score AS bigint) AS score FROM r WHERE rank <= {k}"


@query("offer_ranking", _offer_sql("job_detail", 2))
def offer_ranking(spark, sf_dir):
    """The two best offers of every listing's detail page, one per offer category."""
    rows = R.rank_offers(A.jobs(spark, sf_dir), A.offers(spark, sf_dir))
    return rows.select("id", F.col("rank").cast("bigint").alias("rank"), "offer_id", "offer_category", F.col("score").cast("bigint").alias("score"))


@query("offer_ranking_resources", _offer_sql("resource_page", 4))
def offer_ranking_resources(spark, sf_dir):
    rows = R.rank_offers(A.jobs(spark, sf_dir), A.offers(spark, sf_dir), placement="resource_page", k=4)
    return rows.select("id", F.col("rank").cast("bigint").alias("rank"), "offer_id", "offer_category", F.col("score").cast("bigint").alias("score"))


def _similar_sql():
    tags = f"list_filter(list_transform(regexp_split_to_array(coalesce(tags, ''), '[,;|]'), lambda t: {D.strip('t')}), lambda t: t <> '')[1:8]"
    tag_w = f"list_filter(list_distinct(list_transform({tags}, lambda t: {D.set_text(D.keywords('t'))})), lambda k: k <> '')"
    text = "coalesce(summary, '') || ' ' || coalesce(job_description, '') || ' ' || coalesce(requirements, '') || ' ' || coalesce(department, '')"
    both = lambda n: f"len(list_intersect(b.{n}, c.{n}))"
    same = lambda n, w: f"CASE WHEN coalesce(b.{n}, '') <> '' AND b.{n} = c.{n} THEN {w} ELSE 0 END"
    score = (
        f"CASE WHEN b.category = c.category THEN 24 WHEN b.remote_cat AND c.remote_cat THEN 8 ELSE 0 END + {same('employment_type', 8)} + {same('remote_status', 8)} + {same('experience_level', 6)} "
        f"+ {both('title_w')} * 8 + {both('tag_w')} * 10 + least({both('text_w')}, 10) * 2 + least({both('place_w')}, 2) * 3"
    )
    feats = (
        f"id, category, featured, created_at, employment_type, remote_status, experience_level, list_contains({D.keywords('category')}, 'remote') AS remote_cat, "
        f"{D.keywords('title')} AS title_w, {tag_w} AS tag_w, {D.keywords(text)} AS text_w, {D.keywords('location')} AS place_w"
    )
    return A.with_views(
        A.JOBS_SQL, *D.public_ctes("jobs"),
        f"c AS (SELECT {feats} FROM pub WHERE is_public)",
        f"b AS (SELECT {feats} FROM jobs)",
        f"s AS (SELECT b.id, c.id AS candidate_id, {score} AS score, c.featured, c.created_at FROM b, c WHERE b.id <> c.id)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, featured DESC, created_at DESC, candidate_id DESC) AS rank FROM s)",
    ) + "SELECT id, rank, candidate_id, cast(score AS bigint) AS score FROM r WHERE rank <= 4"


@query("similar_items", _similar_sql())
def similar_items(spark, sf_dir):
    """Four similar public listings for every listing of the table."""
    jobs = A.jobs(spark, sf_dir)
    rows = similar(jobs, jobs, A.as_of_date())
    return rows.select("id", F.col("rank").cast("bigint").alias("rank"), "candidate_id", "score")
