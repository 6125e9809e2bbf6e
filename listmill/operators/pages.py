"""Pages to records: titles, links, page class, cards, detail records, crawl frontier."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import classify as C
from ..functions import urls as U
from ..functions import vocab as V
from ..functions.quality import is_merged
from ..functions.text import (
    bind, clean_text, content_hash, empty_if_null, normalize_block, null_if_empty, one_line, unescape,
)
from ..session import cut_lineage
from . import html_pass

SETTINGS_BROADCAST = 10_000     # rules of so many sources at most travel to every task; more are joined by shuffle


def few_rows(rules: DataFrame) -> bool:
    return rules.limit(SETTINGS_BROADCAST + 1).count() <= SETTINGS_BROADCAST


SILENT_BLOCK = r"(?is)<(script|style|noscript|svg|form|iframe)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<![^>]*>"
HIDDEN_BLOCK = (
    r"(?is)<(\w+)\b[^>]*(?:\shidden(?=[\s>=/])|\saria-hidden=[\"']?true|"
    r"style=[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))[^>]*>.*?</\1\s*>"
)


BLOCK_EDGE = r"(?i)</(?:p|div|section|article|tr|li|h[1-6])\s*>|<(?:br|li|h[1-6])\b[^>]*>"


def html_lines(c: Column) -> Column:
    """Markup off, before cleaning: block edges leave a blank line, other tags a line break."""
    shown = bind(
        F.regexp_replace(empty_if_null(c), SILENT_BLOCK, ""),
        lambda t: F.when(t.rlike("(?i)hidden|display"), F.regexp_replace(t, HIDDEN_BLOCK, "")).otherwise(t),
    )
    blocks = F.regexp_replace(shown, BLOCK_EDGE, "\n\n")
    # tags become one marker each, and runs of markers collapse: a repeated group would recurse once per tag
    return unescape(F.regexp_replace(F.regexp_replace(blocks, r"<[^>]+>", "\x01"), "\x01+", "\n"))


def html_to_text(c: Column) -> Column:
    return normalize_block(html_lines(c))


def tag_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return clean_text(F.regexp_replace(inner, r"<[^>]+>", " "))


def meta(html: Column, names) -> Column:
    """Content of the first of several named meta tags that has one."""

    def one(name):
        n = name.replace(".", r"\.")
        named = rf"(?:property|name)\s*=\s*[\"']{n}[\"']"
        after = F.regexp_extract(html, rf"(?is)<meta\b[^>]*{named}[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
        before = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*{named}", 1)
        return null_if_empty(clean_text(F.coalesce(null_if_empty(after), before)))

    return F.coalesce(*[one(n) for n in names], F.lit(""))


def page_title(html: Column) -> Column:
    return F.coalesce(
        null_if_empty(tag_text(html, "h1")),
        null_if_empty(meta(html, ["og:title", "twitter:title"])),
        tag_text(html, "title"),
    )


def main_html(html: Column) -> Column:
    """Inner markup of article, else main, else body, else everything."""
    tries = [null_if_empty(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*)</{t}\s*>", 1)) for t in ("article", "main", "body")]
    return F.coalesce(*tries, html)


# ------------------------------------------------------------------ structured data
_LD = "(?is)<script[^>]*type\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script\\s*>"


def json_ld(pages: DataFrame) -> DataFrame:
    """Every JobPosting in the JSON-LD scripts of a page: a list, one object, or a graph."""
    bodies = pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_LD), F.lit(1))).alias("script", "body")
    )
    doc = bodies.withColumn("v", F.try_parse_json("body")).filter("v is not null")
    get = lambda v, path, t: F.try_variant_get(v, path, t)
    as_list = lambda v, path: F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    top = F.coalesce(get(F.col("v"), "$", "array<variant>"), F.array("v"))
    nodes = doc.select("page_id", "url", "script", top.alias("top"))
    graph = F.flatten(F.transform("top", lambda n: as_list(n, "$['@graph']")))
    nodes = nodes.select("page_id", "url", "script", F.posexplode(F.concat("top", graph)).alias("pos", "n"))
    n = F.col("n")
    kinds = F.coalesce(get(n, "$['@type']", "array<string>"), F.array(get(n, "$['@type']", "string")))
    nodes = nodes.filter(F.exists(kinds, lambda k: F.lower(k) == "jobposting"))
    place = F.coalesce(F.get(as_list(n, "$.jobLocation"), F.lit(0)), get(n, "$.jobLocation", "variant"))
    part = lambda k: null_if_empty(clean_text(get(place, f"$.address.{k}", "string")))
    s = lambda k: get(n, f"$.{k}", "string")
    return nodes.select(
        "page_id", "url", "script", "pos",
        s("title").alias("title"),
        F.coalesce(get(n, "$.hiringOrganization.name", "string"), s("hiringOrganization")).alias("company"),
        null_if_empty(
            F.concat_ws(", ", part("addressLocality"), part("addressRegion"), part("addressCountry"))
        ).alias("location"),
        html_to_text(s("description")).alias("summary"),
        s("description").alias("description_html"),
        U.normalize_url(F.coalesce(null_if_empty(s("url")), F.col("url")), F.col("url")).alias("apply_url"),
        C.parse_date(s("datePosted")).alias("posted_at"),
        C.parse_date(s("validThrough")).alias("expires_at"),
        s("employmentType").alias("employment_type"),
        s("industry").alias("department"),
        html_to_text(F.coalesce(s("qualifications"), s("skills"))).alias("requirements"),
    )


# ------------------------------------------------------------------ links
_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"


def _href(attrs: Column) -> Column:
    found = unescape(F.regexp_extract(attrs, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 1))
    return F.coalesce(null_if_empty(found), F.regexp_extract(attrs, r"(?is)\bhref\s*=\s*'([^']*)'", 1))


def _anchor_text(inner: Column) -> Column:
    return clean_text(F.regexp_replace(inner, r"<[^>]+>", " "))


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per anchor with an address: position, raw and absolute address, text, attributes; ``keep`` columns stay."""
    tag = _ANCHOR
    rows = pages.select(
        "page_id", *keep, F.col("url").alias("page_url"),
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("attrs"),
                F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("inner"),
            )
        ).alias("pos", "a"),
    )
    attrs = F.col("a.attrs")
    href = _href(attrs)
    return rows.select(
        "page_id", *keep, "page_url", "pos", attrs.alias("attrs"), href.alias("href"),
        U.normalize_url(href, F.col("page_url")).alias("url"), _anchor_text(F.col("a.inner")).alias("text"),
    ).filter("url <> ''")


def page_anchors(html: Column, url: Column) -> Column:
    """The same within the page's row: struct(url, text) of every anchor with an address, in order."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)).alias("attrs"), F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(2)).alias("inner")
    )
    listed = F.transform(zipped, lambda a: F.struct(U.normalize_url(_href(a["attrs"]), url).alias("url"), _anchor_text(a["inner"]).alias("text")))
    return F.filter(listed, lambda a: a["url"] != "")


def _excluded(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(V.LINK_EXCLUDES))


def _same_host(url: Column, page_url: Column) -> Column:
    return U.host(url) == U.host(page_url)


def _is_listing_url(url: Column, page_url: Column) -> Column:
    pq = F.lower(F.concat(U.path(url), F.lit("?"), U.query(url)))
    return _same_host(url, page_url) & ~_excluded(url) & pq.rlike(V.LISTING_URL)


def first_per_page(links: DataFrame) -> DataFrame:
    """Each address once per page, at its first position (combined before the shuffle)."""
    rest = [c for c in links.columns if c not in ("page_id", "url")]
    first = links.groupBy("page_id", "url").agg(F.min(F.struct("pos", *[c for c in rest if c != "pos"])).alias("f"))
    return first.select("page_id", "url", "f.*")


def detail_links(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Links to detail pages.

    ``rules`` (few rows, one per source; the pages then carry ``source_name``) may add
    include/exclude patterns, allow other hosts, or replace the tests by a host and path rule.
    """
    links = anchors(pages, *(["source_name"] if rules is not None else []))
    if rules is not None:
        links = links.join(F.broadcast(rules) if few_rows(rules) else rules, "source_name", "left")
    else:
        links = links.withColumns(
            {n: F.lit(None).cast("string") for n in ("include_pattern", "exclude_pattern", "only_pattern")}
        ).withColumn("allow_external", F.lit(False))
    url, text, page_url = F.col("url"), F.col("text"), F.col("page_url")
    trim = lambda c: F.rtrim(c, F.lit("/"))
    itself = (trim(url) == trim(page_url)) & text.rlike(r"(?i)jobs?|vacanc|careers?")
    wanted = F.lower(U.path(url)).rlike(V.DETAIL_PATH) | text.rlike("(?i)" + V.DETAIL_ANCHOR)
    general = (
        ~itself
        & (F.coalesce("allow_external", F.lit(False)) | _same_host(url, page_url))
        & ~_excluded(url)
        & ~F.coalesce(F.expr("url rlike concat('(?i)', exclude_pattern)"), F.lit(False))
        & F.coalesce(F.expr("url rlike concat('(?i)', include_pattern)"), F.lit(True))
        & ~_is_listing_url(url, page_url)
        & wanted
    )
    by_rule = F.expr("concat(url, ' ', text) rlike concat('(?i)', only_pattern)")
    keep = F.when(F.col("only_pattern").isNotNull(), by_rule).otherwise(general)
    return first_per_page(links.filter(keep).select("page_id", "page_url", "pos", "url", "text"))


def pagination_links(pages: DataFrame) -> DataFrame:
    """Links to further listing pages: rel/class/label hints, "next" texts, numbers in a pager."""
    pager = r"(?is)<(?:nav|div|ul|ol|section)\b[^>]*(?:pagination|pager|page-numbers)[^>]*>(.*?)</(?:nav|div|ul|ol|section)>"
    links = anchors(pages.withColumn("pagers", F.regexp_extract_all("html", F.lit(pager), F.lit(1))), "pagers")
    attrs, text = F.col("attrs"), F.col("text")
    hinted = attrs.rlike(
        r"(?i)\brel\s*=\s*[\"']?[^\"']*\bnext\b|\bclass\s*=\s*[\"'][^\"']*(?:\bnext\b|nextpostslink|page-numbers)|"
        r"\b(?:aria-label|title)\s*=\s*[\"'][^\"']*next"
    )
    named = text.rlike("(?i)" + V.PAGE_ANCHOR)
    numbered = text.rlike(r"^(?:\d+|\.\.\.|…)$") & F.exists("pagers", lambda p: F.contains(p, F.col("href")))
    ok = (hinted | named | numbered) & _is_listing_url(F.col("url"), F.col("page_url"))
    return first_per_page(links.filter(ok).select("page_id", "page_url", "pos", "url", "text"))


def apply_links(pages: DataFrame) -> DataFrame:
    """Apply address of each page: apply-like anchor, else first foreign non-social, else itself."""
    links = anchors(pages)
    says = F.col("text").rlike("(?i)" + V.APPLY_ANCHOR) & ~_excluded(F.col("url"))
    social = F.col("url").rlike("|".join(h.replace(".", r"\.") for h in V.SOCIAL_HOSTS))
    foreign = (U.host(F.col("url")) != U.host(F.col("page_url"))) & ~social
    best = links.groupBy("page_id").agg(
        F.min(F.when(says, F.struct("pos", "url"))).alias("a"), F.min(F.when(foreign, F.struct("pos", "url"))).alias("b")
    )
    return pages.select("page_id", "url").join(best, "page_id", "left").select(
        "page_id", F.coalesce("a.url", "b.url", "url").alias("apply_url")
    )


def apply_address(links: Column, url: Column, foreign: bool = True) -> Column:
    """``apply_links`` within the page's row, over ``page_anchors``."""
    says = F.filter(links, lambda a: a["text"].rlike("(?i)" + V.APPLY_ANCHOR) & ~_excluded(a["url"]))
    social = "|".join(h.replace(".", r"\.") for h in V.SOCIAL_HOSTS)
    away = F.filter(links, lambda a: (U.host(a["url"]) != U.host(url)) & ~a["url"].rlike(social))
    tries = [says, away] if foreign else [says]
    return F.coalesce(*[F.get(t, F.lit(0))["url"] for t in tries], url)


def page_facts(pages: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """What the page class depends on: h1, title, number of role-like links and cards, phrases; no join unless cards are given."""
    html = F.col("html")
    rows = pages.select("page_id", "url", *[v.alias(n) for n, v in _facts(html, page_anchors(html, F.col("url"))).items()])
    if cards is None:
        return rows.withColumn("n_cards", F.lit(0).cast("bigint"))
    n = cards.groupBy("page_id").agg(F.count("*").alias("n_cards"))
    return rows.join(n, "page_id", "left").withColumn("n_cards", F.coalesce("n_cards", F.lit(0)))


def _facts(html: Column, links: Column) -> dict[str, Column]:
    return {
        "h1": tag_text(html, "h1"), "head_title": tag_text(html, "title"),
        "has_phrase": clean_text(html_lines(html)).rlike("(?i)" + V.LISTING_PHRASES),
        "role_links": F.size(F.filter(links, lambda a: C.is_role(a["text"]))).cast("bigint"),
    }


def page_kind(facts: DataFrame) -> DataFrame:
    """listing, detail or other."""
    h1 = F.col("h1")
    listing = ~C.is_role(h1) & (
        (F.col("n_cards") > 1)
        | F.concat_ws(" ", h1, F.col("head_title")).rlike("(?i)" + V.LISTING_TITLE_WORDS)
        | (F.col("role_links") >= 4)
        | F.col("has_phrase")
    )
    path = F.rtrim(F.lower(U.path(F.col("url"))), F.lit("/"))
    detail_path = path.rlike("jobs|job|careers|career|vacanc|position|202|opportun") & ~path.rlike(r"/(?:jobs?|careers?|vacancies)$")
    kind = F.when(listing, "listing").when(detail_path | C.is_role(h1), "detail").otherwise("other")
    return facts.withColumn("kind", kind)


# ------------------------------------------------------------------ tree pass, cards, details
def read_tree(pages: DataFrame) -> DataFrame:
    """Main text and cards of each page, with an ``error`` column for pages that failed.

    A column ``selectors`` (map; keys detail_container or description, job_cards, title, job_links) holds the page's source's
    own selectors, which come before the general ones. Columns other than html and selectors stay.
    """
    kept = [f for f in pages.schema.fields if f.name not in ("html", "selectors")]
    found = T.StructType.fromDDL(html_pass.FOUND)
    return pages.mapInArrow(html_pass.read_pages, T.StructType([*kept, *found.fields]))


def page_text(tree: DataFrame) -> DataFrame:
    return tree.filter("error is null").select("page_id", "url", normalize_block(F.col("main_text")).alias("text"))


def quarantine(tree: DataFrame) -> DataFrame:
    return tree.filter("error is not null").select("page_id", "url", "error")


def cards(tree: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Listing cards as raw records; cards without a title or with several listings drop out."""
    rows = tree.filter("error is null").select("page_id", "url", F.explode("cards").alias("c"))
    c = F.col("c")
    tidy = lambda t: F.regexp_replace(clean_text(t), r"(?i)\s*\|\s*(?:apply|deadline|closing date).*$", "")
    plain_role = r"(?i)\b(?:officer|manager|assistant|engineer|developer|coordinator|analyst|accountant|consultant|intern)\b"
    named = F.filter(
        F.transform(c["titles"], tidy),
        lambda t: F.length(t).between(5, 140) & (C.is_role(t) | t.rlike(plain_role)),
    )
    text = normalize_block(c["text"], max_chars=3000)
    lines = F.filter(
        F.transform(F.slice(F.split(normalize_block(c["text"]), "\n"), 1, 6), one_line),
        lambda t: F.length(t).between(5, 140) & C.is_role(t),
    )
    own = F.filter(
        F.transform(c["links"], lambda x: U.normalize_url(x["href"], F.col("url"))),
        lambda u: (u != "") & ~_excluded(u) & _same_host(u, F.col("url")),
    )
    field = lambda n, labels: F.coalesce(c[n], C.labelled(c["text"], labels))
    rows = rows.select(
        "page_id", F.col("url").alias("listing_url"), c["pos"].alias("pos"),
        F.coalesce(F.get(named, F.lit(0)), F.get(lines, F.lit(0))).alias("title"),
        text.alias("summary"),
        F.coalesce(F.get(own, F.lit(0)), F.col("url")).alias("source_url"),
        field("company", ["Company", "Organisation", "Organization", "Employer"]).alias("company"),
        field("location", ["Location", "City", "Country", "Duty Station", "Work Location"]).alias("location"),
        field("employment", ["Type", "Job Type", "Employment", "Contract"]).alias("employment_type"),
        field("salary", ["Salary", "Compensation", "Pay"]).alias("salary_range"),
        c["data_id"].alias("data_id"),
    ).filter("title is not null")
    rows = rows.filter(~is_merged(F.col("title"), F.col("summary")))
    made = content_hash([F.col(n) for n in ("listing_url", "title", "company", "location")] + [F.col("pos").cast("string")])
    return rows.withColumns(
        {
            "company": F.coalesce("company", C.company_from_text(F.col("title"), F.col("summary"))),
            "apply_url": F.col("source_url"),
            "external_id": F.coalesce(null_if_empty(clean_text(F.col("data_id"))), F.substring(made, 1, 16)),
            "expires_at": C.deadline(F.col("summary")),
            "requirements": C.section(F.col("summary"), V.REQUIREMENT_HEADINGS[:4]),
        }
    ).drop("data_id")


def _posted(html: Column) -> Column:
    return null_if_empty(meta(html, ["article:published_time", "datePublished", "date"]))


def _first_posting(pages: DataFrame) -> DataFrame:
    """page_id and ``ld``: the first posting in each page's structured data."""
    ld = json_ld(pages)
    fields = [c for c in ld.columns if c not in ("page_id", "script", "pos")]
    return ld.groupBy("page_id").agg(F.min(F.struct("script", "pos", *fields)).alias("ld"))


def detail_records(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One raw record per detail page: structured data first, else labelled fields of the main text.

    Everything that needs the markup is taken from it in the page's own row, before and in the tree pass; what goes
    through a join is the records' fields. ``rules`` (one row per source) may fix the company, take the role from the body, or
    reject pages by a pattern; pages then carry ``source_name``.
    """
    html, url = F.col("html"), F.col("url")
    ready = pages.withColumn("links", page_anchors(html, url))
    ready = ready.withColumns(
        _facts(html, F.col("links"))
        | {"page_title": page_title(html), "posted": _posted(html), "author": null_if_empty(meta(html, ["article:author", "author"])),
           "apply_url": apply_address(F.col("links"), url)}
    ).drop("links")
    tree = read_tree(ready).filter("error is null").withColumn("n_cards", F.size("cards")).drop("cards", "error")
    rows = page_kind(tree.withColumn("text", normalize_block(F.col("main_text"))).drop("main_text"))
    rows = rows.join(_first_posting(pages), "page_id", "left")
    if rules is not None:
        rows = rows.join(F.broadcast(rules) if few_rows(rules) else rules, "source_name", "left")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("fixed_company", "reject_pattern")})
        rows = rows.withColumn("role_from_body", F.lit(False))
    text, title = F.col("text"), F.col("page_title")
    title = F.when(
        F.coalesce("role_from_body", F.lit(False)) & ~C.is_role(title), F.coalesce(C.role_from_text(text), title)
    ).otherwise(title)
    plain_fields = {
        "title": title,
        "company": F.coalesce(F.col("fixed_company"), C.labelled(text, V.COMPANY_LABELS), F.col("author"), C.company_from_text(title, text)),
        "location": C.labelled(text, V.LOCATION_LABELS, 120, below=True),
        "summary": text,
        "apply_url": F.col("apply_url"),
        "posted_at": C.parse_date(F.coalesce(F.col("posted"), C.labelled(text, V.POSTED_LABELS, 120, below=True))),
        "expires_at": C.deadline(text),
        "department": C.labelled(text, V.DEPARTMENT_LABELS, 120, below=True),
        "employment_type": C.labelled(text, V.EMPLOYMENT_LABELS, 120, below=True),
        "salary_range": C.labelled(text, V.SALARY_LABELS, 120, below=True),
        "requirements": C.section(text, V.REQUIREMENT_HEADINGS[:4]),
    }
    has_ld = F.col("ld").isNotNull()
    in_ld = {"title", "company", "location", "summary", "apply_url", "posted_at", "expires_at", "department", "employment_type", "requirements"}
    usable = has_ld | (
        (F.col("kind") != "listing")
        & (title != "")
        & ~is_merged(title, text)
        & ~F.coalesce(F.expr("concat_ws(' ', text) rlike concat('(?i)', reject_pattern)"), F.lit(False))
    )
    return rows.filter(usable).select(
        "page_id", *[c for c in ("source_name",) if c in rows.columns], F.col("url").alias("source_url"),
        *[
            (F.when(has_ld, F.col(f"ld.{n}")).otherwise(v) if n in in_ld else F.when(~has_ld, v)).alias(n)
            for n, v in plain_fields.items()
        ],
    )


def page_records(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Raw records of pages of any kind: detail pages give one, listing pages without detail links their cards."""
    links = detail_links(pages).select("page_id").distinct()
    html = F.col("html")
    facts = pages.join(links, "page_id", "left_anti").withColumns(_facts(html, page_anchors(html, F.col("url"))))
    tree = page_kind(read_tree(facts).withColumn("n_cards", F.size("cards"))).filter("kind = 'listing'")
    names = ["source_name"] if "source_name" in pages.columns else []
    carded = cards(tree.select("page_id", "url", "error", "cards")).withColumn("pos", F.col("pos").cast("int"))
    carded = carded.join(tree.select("page_id", *names), "page_id")
    details = detail_records(pages, rules).withColumn("pos", F.lit(0))
    return details.unionByName(carded.drop("listing_url"), allowMissingColumns=True)


# ------------------------------------------------------------------ crawl frontier
def listing_links(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pagination links, detail links, direct records) of stored pages, keyed by the page's address.

    A page without detail links that isn't one posting itself gives its cards as records, and no links.
    """
    address = U.normalize_url(F.col("url"))
    details = cut_lineage(detail_links(pages).select(U.normalize_url(F.col("page_url")).alias("page_url"), "page_id", "url", "pos"))
    bare = pages.join(details.select("page_id").distinct(), "page_id", "left_anti")
    html = F.col("html")
    facts = bare.withColumns(_facts(html, page_anchors(html, F.col("url"))))
    tree = page_kind(read_tree(facts).withColumn("n_cards", F.size("cards"))).filter("kind <> 'detail'")
    direct = cards(tree.select("page_id", "url", "error", "cards")).groupBy(U.normalize_url(F.col("listing_url")).alias("page_url")).agg(F.count("*").alias("n"))
    direct = cut_lineage(direct)
    nav = pagination_links(pages).select(U.normalize_url(F.col("page_url")).alias("page_url"), "url", "pos")
    return cut_lineage(nav.join(direct.select("page_url"), "page_url", "left_anti")), details.drop("page_id"), direct


def frontier(starts: DataFrame, nav: DataFrame, details: DataFrame, direct: DataFrame, sources: DataFrame) -> DataFrame:
    """What a bounded crawl of the stored pages takes per source: source_name, kind, url, rank, n_records.

    starts(source_name, url, pos); nav and details(page_url, url, pos) and direct(page_url, n) as found on the pages;
    sources(source_name, max_pages, max_detail). Listing pages are walked breadth first up to ``max_pages``; each step joins
    the last level alone. Detail addresses count once per source in discovery order, direct records page by page; the walk
    ends after the page that fills ``max_detail`` of either. kind ``detail`` has the addresses with their rank, kind
    ``direct`` the pages, ranked by visit, with the number of records taken from them.
    """
    caps = sources.select("source_name", "max_pages", "max_detail")
    by_order = Window.partitionBy("source_name")

    def capped(df, order, cap):
        """First ``cap`` rows of each source; a big source is first cut down in 64 parts."""
        parts = Window.partitionBy("source_name", "_part").orderBy(*order)
        cut = (
            df.join(caps.select("source_name", cap), "source_name")
            .withColumn("_part", F.pmod(F.xxhash64("url"), F.lit(64)))
            .withColumn("_n", F.row_number().over(parts))
            .filter(F.col("_n") <= F.col(cap))
        )
        ranked = cut.withColumn("_n", F.row_number().over(by_order.orderBy(*order)))
        return ranked.filter(F.col("_n") <= F.col(cap)).drop("_part", cap)

    first = starts.groupBy("source_name", "url").agg(F.min("pos").alias("pos"))
    last = cut_lineage(capped(first, ["pos", "url"], "max_pages").select("source_name", "url", F.col("_n").cast("bigint").alias("n")))
    seen = last
    links = nav.select(F.col("page_url").alias("url"), F.col("url").alias("to"), "pos")
    while True:
        new = last.join(links, "url").groupBy("source_name", F.col("to").alias("url")).agg(F.min(F.struct("n", "pos")).alias("o"))
        new = new.join(seen.select("source_name", "url"), ["source_name", "url"], "left_anti")
        have = seen.groupBy("source_name").agg(F.count("*").alias("have"))
        last = cut_lineage(
            capped(new, ["o.n", "o.pos", "url"], "max_pages")
            .join(have, "source_name").join(caps, "source_name")
            .filter(F.col("have") + F.col("_n") <= F.col("max_pages"))
            .select("source_name", "url", (F.col("have") + F.col("_n")).alias("n"))
        )
        if last.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(last))

    walked = seen.select("source_name", "n", F.col("url").alias("page_url"))
    found = walked.join(details, "page_url").groupBy("source_name", "url").agg(F.min(F.struct("n", "pos")).alias("o"))
    taken = walked.join(direct.withColumnRenamed("n", "records"), "page_url")
    # what each page adds, and the first page that fills a cap; a source has at most max_pages of them
    adds = found.groupBy("source_name", F.col("o.n").alias("n")).agg(F.count("*").alias("d"), F.lit(0).cast("bigint").alias("r")).unionByName(
        taken.select("source_name", "n", F.lit(0).cast("bigint").alias("d"), F.col("records").alias("r"))
    )
    upto = Window.partitionBy("source_name").orderBy("n")
    sums = adds.withColumns({"ds": F.sum("d").over(upto), "rs": F.sum("r").over(upto)}).join(caps, "source_name")
    full = (F.col("ds") >= F.col("max_detail")) | (F.col("rs") >= F.col("max_detail"))
    end = sums.filter(full).groupBy("source_name").agg(F.min("n").alias("end"))
    inside = lambda df, n: df.join(end, "source_name", "left").filter(F.col("end").isNull() | (n <= F.col("end"))).drop("end")
    urls = capped(inside(found, F.col("o.n")), ["o.n", "o.pos", "url"], "max_detail").select(
        "source_name", F.lit("detail").alias("kind"), "url", F.col("_n").cast("bigint").alias("rank"), F.lit(1).cast("bigint").alias("n_records")
    )
    cards_of = inside(sums, F.col("n")).filter("r > 0").join(walked, ["source_name", "n"]).select(
        "source_name", F.lit("direct").alias("kind"), F.col("page_url").alias("url"), F.col("n").alias("rank"),
        F.least("r", F.col("max_detail") - (F.col("rs") - F.col("r"))).cast("bigint").alias("n_records"),
    )
    return urls.unionByName(cards_of)
