"""Pages to titles, links, page classes, cards and records."""

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import normalize_block
from ..operators import pages as P
from . import adaptors as A
from . import duck as D
from .registry import query


def _tag_sql(tag):
    inner = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
    return D.clean(f"regexp_replace({inner}, '<[^>]+>', ' ', 'g')")


@query(
    "page_titles",
    A.with_views(A.CRAWL_SQL) + f"SELECT page_id, coalesce(nullif({_tag_sql('h1')}, ''), {_tag_sql('title')}) AS title FROM crawl",
)
def page_titles(spark, sf_dir):
    return A.crawl_pages(spark, sf_dir).select("page_id", P.page_title(F.col("html")).alias("title"))


@query(
    "page_meta",
    A.with_views(A.CRAWL_SQL)
    + "SELECT page_id, replace(regexp_extract(html, 'og:title\" content=\"([^\"]*)\"', 1), '&amp;', '&') AS og_title, regexp_extract(html, 'content=\"([^\"]*)\" name=\"date\"', 1) AS day FROM crawl",
)
def page_meta(spark, sf_dir):
    h = F.col("html")
    return A.crawl_pages(spark, sf_dir).select(
        "page_id", P.meta(h, ["twitter:title", "og:title"]).alias("og_title"), P.meta(h, ["article:published_time", "date"]).alias("day")
    )


_TAG = "(?is)<a\\b([^>]*)>(.*?)</a\\s*>"
_ANCHORS = [
    A.CRAWL_SQL,
    f"z AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '{_TAG}', 1) AS xs, regexp_extract_all(html, '{_TAG}', 2) AS ys FROM crawl)",
    "r AS (SELECT page_id, page_url, unnest(range(len(xs))) AS pos, xs, ys FROM z)",
    "t AS (SELECT page_id, page_url, pos, xs[pos + 1] AS attrs, ys[pos + 1] AS inner_ FROM r)",
    f"h AS (SELECT page_id, page_url, pos, attrs, regexp_extract(attrs, '(?is)\\bhref\\s*=\\s*\"([^\"]*)\"', 1) AS href, {D.clean(D.rx('inner_', '<[^>]+>', ' '))} AS text FROM t)",
    f"root AS (SELECT *, {D.url_part('page_url', 1)} || '://' || {D.url_part('page_url', 2)} AS root, {D.url_part('page_url', 3)} AS base_path FROM h)",
    "links AS (SELECT page_id, page_url, pos, attrs, href, text, CASE WHEN regexp_matches(href, '^https?:') THEN regexp_replace(href, '#.*$', '') "
    "WHEN starts_with(href, '/') THEN root || regexp_replace(href, '#.*$', '') WHEN starts_with(href, '?') THEN root || coalesce(nullif(base_path, ''), '/') || href END AS url FROM root)",
]
_HOST = lambda c: f"lower({D.url_part(c, 2)})"
_EXCLUDED = "regexp_matches(url, '(?i)" + "|".join(V.LINK_EXCLUDES) + "')"
_LISTING = f"({_HOST('url')} = {_HOST('page_url')} AND NOT {_EXCLUDED} AND regexp_matches(lower({D.url_part('url', 3)} || '?' || {D.url_part('url', 4)}), '{V.LISTING_URL}'))"


@query(
    "page_links",
    A.with_views(
        *_ANCHORS,
        f"d AS (SELECT * FROM links WHERE {_HOST('url')} = {_HOST('page_url')} AND NOT {_EXCLUDED} AND NOT {_LISTING} "
        f"AND NOT (rtrim(url, '/') = rtrim(page_url, '/') AND {D.hit('text', 'jobs?|vacanc|careers?')}) "
        f"AND (regexp_matches(lower({D.url_part('url', 3)}), '{V.DETAIL_PATH}') OR {D.hit('text', V.DETAIL_ANCHOR)}))",
    )
    + "SELECT page_id, url, min(pos) AS pos, arg_min(text, pos) AS text FROM d GROUP BY page_id, url",
)
def page_links(spark, sf_dir):
    """Detail-page links, each once per page at its first position."""
    rows = P.detail_links(A.crawl_pages(spark, sf_dir))
    return rows.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "text")


@query(
    "page_links_external",
    A.with_views(
        *_ANCHORS,
        f"d AS (SELECT * FROM links WHERE NOT {_EXCLUDED} AND NOT {_LISTING} AND regexp_matches(url, '(?i)/f/|/jobs/') AND NOT regexp_matches(url, '(?i)/2\\?') "
        f"AND (regexp_matches(lower({D.url_part('url', 3)}), '{V.DETAIL_PATH}') OR {D.hit('text', V.DETAIL_ANCHOR)}))",
    )
    + "SELECT page_id, url, min(pos) AS pos FROM d GROUP BY page_id, url",
)
def page_links_external(spark, sf_dir):
    """Detail links under a source's own rules: other hosts allowed, include and exclude patterns."""
    pages = A.crawl_pages(spark, sf_dir).withColumn("source_name", F.lit("board"))
    rules = spark.createDataFrame(
        [("board", r"/f/|/jobs/", r"/2\?", None, True)],
        "source_name string, include_pattern string, exclude_pattern string, only_pattern string, allow_external boolean",
    )
    return P.detail_links(pages, rules).select("page_id", "url", F.col("pos").cast("bigint").alias("pos"))


@query(
    "pagination_links",
    A.with_views(*_ANCHORS, f"d AS (SELECT * FROM links WHERE {_LISTING} AND (contains(attrs, 'rel=\"next\"') OR regexp_matches(text, '^\\d+$')))")
    + "SELECT page_id, url, min(pos) AS pos FROM d GROUP BY page_id, url",
)
def pagination_links(spark, sf_dir):
    rows = P.pagination_links(A.crawl_pages(spark, sf_dir))
    return rows.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"))


@query(
    "apply_links",
    A.with_views(
        *_ANCHORS,
        f"b AS (SELECT page_id, arg_min(url, pos) FILTER (WHERE {D.hit('text', V.APPLY_ANCHOR)} AND NOT {_EXCLUDED}) AS a, "
        f"arg_min(url, pos) FILTER (WHERE {_HOST('url')} <> {_HOST('page_url')} AND NOT regexp_matches(url, 'facebook\\.com|linkedin\\.com|instagram\\.com|twitter\\.com')) AS b FROM links GROUP BY page_id)",
    )
    + "SELECT c.page_id, coalesce(b.a, b.b, c.url) AS apply_url FROM crawl c LEFT JOIN b ON b.page_id = c.page_id",
)
def apply_links(spark, sf_dir):
    return P.apply_links(A.crawl_pages(spark, sf_dir))


def _breaks(t):
    blocks = f"regexp_replace({t}, {D.q(P.BLOCK_EDGE)}, chr(10) || chr(10), 'g')"
    return f"regexp_replace({blocks}, '(?:<[^>]+>)+', chr(10), 'g')"


_ARTICLE = _breaks("regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1)")


def _lines_sql():
    t = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![^>]*>', '', 'g')"
    return _breaks(t)


_PLAIN = D.clean(_lines_sql())


@query(
    "page_kind",
    A.with_views(
        *_ANCHORS,
        f"n AS (SELECT page_id, count(*) FILTER (WHERE {D.is_role('text')}) AS role_links FROM links WHERE url IS NOT NULL GROUP BY page_id)",
        f"f AS (SELECT c.page_id, lower(rtrim({D.url_part('c.url', 3)}, '/')) AS path, {_tag_sql('h1')} AS h1, {_tag_sql('title')} AS head, coalesce(n.role_links, 0) AS role_links, "
        f"{D.hit(_PLAIN, D.BOUNDARY_L + V.LISTING_PHRASES.replace(chr(92) + 'b', '') + D.BOUNDARY_R)} AS phrase FROM crawl c LEFT JOIN n ON n.page_id = c.page_id)",
    )
    + f"SELECT page_id, role_links, CASE WHEN NOT {D.is_role('h1')} AND ({D.hit('h1 || chr(32) || head', D.BOUNDARY_L + V.LISTING_TITLE_WORDS.replace(chr(92) + 'b', '') + D.BOUNDARY_R)} OR role_links >= 4 OR phrase) THEN 'listing' "
    "WHEN (regexp_matches(path, 'jobs|job|careers|career|vacanc|position|202|opportun') AND NOT regexp_matches(path, '/(?:jobs?|careers?|vacancies)$')) "
    f"OR {D.is_role('h1')} THEN 'detail' ELSE 'other' END AS kind FROM f",
)
def page_kind(spark, sf_dir):
    return P.page_kind(P.page_facts(A.crawl_pages(spark, sf_dir))).select("page_id", "role_links", "kind")


@query(
    "html_to_text",
    A.with_views(
        f"p AS (SELECT page_id, {_lines_sql()} AS body FROM pages)",
        *D.block_ctes("b", "p", D.plain("body")),
    )
    + "SELECT page_id, length(block) AS n_chars, md5(block) AS digest FROM b",
)
def html_to_text(spark, sf_dir):
    """Page text by column expressions."""
    rows = A.texts(spark, sf_dir, "pages").select("page_id", P.html_to_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "main_block",
    A.with_views(
        f"p AS (SELECT page_id, {_ARTICLE} AS body FROM pages)",
        *D.block_ctes("b", "p", D.plain("body")),
    )
    + "SELECT page_id, length(block) AS n_chars, md5(block) AS digest FROM b",
)
def main_block(spark, sf_dir):
    """Text of the main block by column expressions."""
    rows = A.texts(spark, sf_dir, "pages").select("page_id", P.html_to_text(P.main_html(F.col("html"))).alias("text"))
    return rows.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "page_text",
    A.with_views(
        f"p AS (SELECT page_id, {_ARTICLE} AS body FROM pages)",
        *D.block_ctes("b", "p", D.plain("body")),
    )
    + "SELECT page_id, md5(block) AS digest FROM b",
)
def page_text(spark, sf_dir):
    """Main text by the tree pass: boilerplate removed, main container chosen."""
    rows = P.page_text(P.read_tree(A.texts(spark, sf_dir, "pages")))
    return rows.select("page_id", F.md5("text").alias("digest"))


@query(
    "quarantined_pages",
    "SELECT page_id, url FROM pages WHERE false",
)
def quarantined_pages(spark, sf_dir):
    """Pages whose tree pass failed."""
    return P.quarantine(P.read_tree(A.crawl_pages(spark, sf_dir))).select("page_id", "url")


@query(
    "json_ld",
    A.with_views(A.CRAWL_SQL)
    + "SELECT page_id, 'Software Engineer ' || page_id AS title, 'Acme ' || (page_id % 7) AS company, 'Harare, ZW' AS location, 'Build & run.' AS summary, '2024-05-01' AS posted_at, "
    "'2024-08-' || lpad(cast(page_id % 28 + 1 AS varchar), 2, '0') AS expires_at, 'FULL_TIME' AS employment_type FROM crawl WHERE contains(html, 'ld+json')",
)
def json_ld(spark, sf_dir):
    """Postings in the pages' structured data."""
    return P.json_ld(A.crawl_pages(spark, sf_dir)).select(
        "page_id", "title", "company", "location", "summary", "posted_at", "expires_at", "employment_type"
    )


def _root_sql():
    return f"{D.url_part('url', 1)} || '://' || {D.url_part('url', 2)}"


@query(
    "cards",
    A.with_views(
        A.CRAWL_SQL,
        "c AS (SELECT page_id, url, 1 AS pos, 'Finance Manager' AS title, 'A' || page_id AS external_id FROM crawl WHERE contains(html, 'job-card') "
        "UNION ALL SELECT page_id, url, 2, 'Registered Nurse', 'B' || page_id FROM crawl WHERE contains(html, 'job-card'))",
    )
    + f"SELECT page_id, title, external_id, 'Firm ' || (page_id % 20) || ' Holdings' AS company, 'Harare' AS location, "
    f"{_root_sql()} || '/jobs/' || page_id || '/' || pos || '?utm_source=feed' AS source_url, '2024-06-' || lpad(cast(page_id % 28 + 1 AS varchar), 2, '0') AS expires_at FROM c",
)
def cards(spark, sf_dir):
    """Listing cards of a page as raw records."""
    rows = P.cards(P.read_tree(A.crawl_pages(spark, sf_dir)))
    return rows.select("page_id", "title", "external_id", "company", "location", "source_url", "expires_at")


@query("detail_records")
def detail_records(spark, sf_dir):
    """Raw records of detail pages."""
    return P.detail_records(A.crawl_pages(spark, sf_dir))


_CAPS = [("s0", 9, 12), ("s1", 40, 500), ("s2", 200, 30)]
_FRONTIER_SQL = (
    "WITH RECURSIVE " + A.LINKED_SQL + ", "
    + "caps AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {p}, {d})" for s, p, d in _CAPS) + ") t(source, max_pages, max_detail)), "
    + "g AS (SELECT source, url, 'https://' || source || '.example.com' AS root, regexp_extract_all(html, 'href=\"(/list/page/\\d+)\"', 1) AS kids, regexp_extract_all(html, 'href=\"(/jobs/\\d+)\"', 1) AS jobs, "
    + "CASE WHEN contains(html, 'job-card') THEN 2 ELSE 0 END AS direct FROM linked), "
    + "w AS (SELECT source, 1 AS i, ['https://' || source || '.example.com/list/page/1'] AS queue, max_pages FROM caps UNION ALL "
    + "SELECT w.source, i + 1, list_concat(queue, list_filter(list_transform(CASE WHEN g.direct = 0 THEN g.kids ELSE [] END, lambda x: g.root || x), lambda x: NOT list_contains(queue, x))[1 : max_pages - len(queue)]), max_pages "
    + "FROM w LEFT JOIN g ON g.url = w.queue[i] WHERE i <= len(queue)), "
    + "v AS (SELECT w.source, w.i AS n, g.url, g.root, g.jobs, g.direct FROM w JOIN g ON g.url = w.queue[w.i] WHERE w.i <= len(w.queue)), "
    + "d AS (SELECT source, root || job AS url, min(n * 1000 + pos) AS o FROM (SELECT source, n, root, unnest(jobs) AS job, unnest(range(len(jobs))) AS pos FROM v WHERE direct = 0) GROUP BY 1, 2), "
    + "a AS (SELECT v.source, v.n, direct AS r, (SELECT count(*) FROM d WHERE d.source = v.source AND d.o // 1000 = v.n) AS d FROM v), "
    + "s AS (SELECT *, sum(r) OVER q AS rs, sum(d) OVER q AS ds FROM a JOIN caps USING (source) WINDOW q AS (PARTITION BY source ORDER BY n)), "
    + "e AS (SELECT source, min(n) AS stop FROM s WHERE rs >= max_detail OR ds >= max_detail GROUP BY 1), "
    + "k AS (SELECT d.source, url, row_number() OVER (PARTITION BY d.source ORDER BY o) AS rank FROM d LEFT JOIN e ON e.source = d.source WHERE stop IS NULL OR o // 1000 <= stop) "
    + "SELECT k.source AS source_name, 'detail' AS kind, url, rank, CAST(1 AS BIGINT) AS n_records FROM k JOIN caps USING (source) WHERE rank <= max_detail UNION ALL "
    + "SELECT s.source, 'direct', v.url, CAST(s.n AS BIGINT), CAST(least(r, max_detail - (rs - r)) AS BIGINT) FROM s JOIN v ON v.source = s.source AND v.n = s.n LEFT JOIN e ON e.source = s.source WHERE r > 0 AND (stop IS NULL OR s.n <= stop)"
)


@query("frontier_caps", _FRONTIER_SQL)
def frontier_caps(spark, sf_dir):
    """Breadth-first walk over the links found in stored listing pages, under each source's caps."""
    pages = A.linked_pages(spark, sf_dir)
    caps = spark.createDataFrame(_CAPS, "source_name string, max_pages int, max_detail int")
    root = F.concat(F.lit("https://"), F.col("source_name"), F.lit(".example.com/list/page/1"))
    starts = caps.select("source_name", root.alias("url"), F.lit(0).alias("pos"))
    return P.frontier(starts, *P.listing_links(pages), caps)
