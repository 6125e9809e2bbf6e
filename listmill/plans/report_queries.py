"""Click reports, dashboard, bookmarks."""

from pyspark.sql import functions as F

from ..operators import reports as R
from . import adaptors as A
from . import duck as D
from .registry import query

_CTR = "CASE WHEN impressions > 0 THEN round(100.0 * clicks / impressions, 1) ELSE 0.0 END AS ctr"
_SUMS = (
    "cast(sum(CASE WHEN event_type = 'impression' THEN 1 ELSE 0 END) AS bigint) AS impressions, "
    "cast(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS bigint) AS clicks"
)


@query(
    "affiliate_by_placement",
    A.with_views(A.EVENTS_SQL, f"g AS (SELECT placement_id, {_SUMS} FROM ev GROUP BY placement_id)")
    + f"SELECT *, {_CTR} FROM g",
)
def affiliate_by_placement(spark, sf_dir):
    rows = R.events_by_placement(A.events(spark, sf_dir))
    return rows.orderBy(F.desc("clicks"), F.desc("impressions"), "placement_id")


@query(
    "affiliate_by_offer",
    A.with_views(
        A.OFFERS_SQL, A.EVENTS_SQL,
        f"g AS (SELECT o.id, o.display_title, o.offer_category, {_SUMS} FROM offers o LEFT JOIN ev e ON e.offer_id = o.id GROUP BY ALL)",
    )
    + f"SELECT *, {_CTR} FROM g",
)
def affiliate_by_offer(spark, sf_dir):
    """Every offer, also one without events, in report order."""
    rows = R.report_order(R.events_by_offer(A.offers(spark, sf_dir), A.events(spark, sf_dir)))
    return rows.select("id", "display_title", "offer_category", "impressions", "clicks", "ctr")


@query("affiliate_totals", A.with_views(A.EVENTS_SQL) + f"SELECT {_SUMS} FROM ev")
def affiliate_totals(spark, sf_dir):
    return R.event_totals(A.events(spark, sf_dir))


@query(
    "affiliate_recent",
    A.with_views(A.OFFERS_SQL, A.EVENTS_SQL)
    + "SELECT e.id, e.offer_id, o.display_title, e.event_type, strftime(e.created_at, '%Y-%m-%d %H:%M:%S') AS created_at "
    "FROM ev e JOIN offers o ON o.id = e.offer_id ORDER BY e.created_at DESC, e.id DESC LIMIT 50",
)
def affiliate_recent(spark, sf_dir):
    rows = R.recent_events(A.events(spark, sf_dir), A.offers(spark, sf_dir))
    return rows.select(
        "id", "offer_id", "display_title", "event_type",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query("category_counts", A.with_views(A.JOBS_SQL) + "SELECT category, count(*) AS n FROM jobs GROUP BY category")
def category_counts(spark, sf_dir):
    return R.count_by(A.jobs(spark, sf_dir), "category")


@query(
    "dashboard_counts",
    A.with_views(A.JOBS_SQL, A.USERS_SQL, A.SAVED_SQL, A.EVENTS_SQL)
    + "SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE featured) AS featured, "
    "(SELECT count(*) FROM users) AS users, "
    f"(SELECT count(*) FROM users WHERE created_at >= {D.AS_OF} - INTERVAL 7 DAY) AS new_users, "
    "(SELECT count(*) FROM saved) AS saved, "
    "(SELECT count(*) FROM ev WHERE event_type = 'click') AS aff_clicks, "
    "(SELECT count(*) FROM ev WHERE event_type = 'impression') AS aff_impressions",
)
def dashboard_counts(spark, sf_dir):
    return R.dashboard(
        A.jobs(spark, sf_dir), A.users(spark, sf_dir), A.saved(spark, sf_dir), A.events(spark, sf_dir), A.as_of()
    )


@query(
    "saved_listing_join",
    A.with_views(A.JOBS_SQL, A.SAVED_SQL)
    + "SELECT s.user_id, j.id, j.title, strftime(s.created_at, '%Y-%m-%d') AS saved_on FROM saved s JOIN jobs j ON j.id = s.job_id",
)
def saved_listing_join(spark, sf_dir):
    """Bookmarks with their listings, for all users."""
    rows = R.join_saved(A.saved(spark, sf_dir), A.jobs(spark, sf_dir))
    return rows.select("user_id", "id", "title", F.date_format("saved_at", "yyyy-MM-dd").alias("saved_on"))


@query(
    "saved_of_user",
    A.with_views(A.JOBS_SQL, A.SAVED_SQL)
    + "SELECT j.id, j.title, strftime(s.created_at, '%Y-%m-%d') AS saved_on FROM saved s JOIN jobs j ON j.id = s.job_id WHERE s.user_id = 7",
)
def saved_of_user(spark, sf_dir):
    """Bookmarks of one account, newest first."""
    rows = R.join_saved(A.saved(spark, sf_dir), A.jobs(spark, sf_dir), 7).orderBy(F.desc("saved_at"), F.desc("id"))
    return rows.select("id", "title", F.date_format("saved_at", "yyyy-MM-dd").alias("saved_on"))


@query(
    "recent_users",
    A.with_views(A.USERS_SQL)
    + "SELECT id, email, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM users ORDER BY users.created_at DESC, id DESC LIMIT 5",
)
def recent_users(spark, sf_dir):
    rows = R.top_recent(A.users(spark, sf_dir), [F.desc("created_at"), F.desc("id")], 5)
    return rows.select("id", "email", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(
    "offer_list",
    A.with_views(A.OFFERS_SQL, A.EVENTS_SQL)
    + f"SELECT o.id, o.is_active, cast(o.priority_score AS bigint) AS priority_score, {_SUMS} FROM offers o LEFT JOIN ev e ON e.offer_id = o.id GROUP BY ALL",
)
def offer_list(spark, sf_dir):
    """Offer administration list: active first, then priority."""
    offers = A.offers(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp"))
    rows = R.offer_list_order(R.events_by_offer(offers, A.events(spark, sf_dir)))
    return rows.select("id", "is_active", F.col("priority_score").cast("bigint").alias("priority_score"), "impressions", "clicks")


@query(
    "click_rate_windows",
    A.with_views(A.EVENTS_SQL)
    + f"SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, placement_id, {_SUMS} FROM ev GROUP BY ALL",
)
def click_rate_windows(spark, sf_dir):
    """Counts per placement and day: the batch twin of the windowed stream."""
    from ..streaming.events import running_counts

    rows = running_counts(A.events(spark, sf_dir), ("placement_id",), "1 day")
    return rows.select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "placement_id", "impressions", "clicks"
    )
