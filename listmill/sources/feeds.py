"""JSON and RSS feeds: payload rows (source_name, url, payload) to raw records.

An unreadable payload gives no rows. Each flattening is one explode; the fields are columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import vocab as V
from ..functions.text import clean_text, empty_if_null, null_if_empty, one_line
from ..functions.urls import normalize_url, path
from ..operators.pages import few_rows, html_to_text, page_records
from ..session import cut_lineage

RAW_COLUMNS = [
    "source_name", "source_url", "title", "company", "location", "category", "summary",
    "description_html", "apply_url", "posted_at", "expires_at", "department", "employment_type",
    "salary_range", "remote_status", "external_id", "requirements",
]
REMOTE_AREA = r"(?i)remote|global|worldwide|emea|africa"


def _get(v, field: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{field}" if not field.startswith("$") else field, kind)


def _items(feeds: DataFrame, *paths: str) -> DataFrame:
    """One row per element of the first array found under the paths ("$" is the whole document)."""
    doc = feeds.withColumn("_doc", F.try_parse_json("payload"))
    arrays = F.coalesce(*[F.try_variant_get("_doc", p, "array<variant>") for p in paths])
    return doc.select("source_name", "url", *_place(feeds), F.posexplode(arrays).alias("pos", "i"))


def _place(feeds: DataFrame) -> list[str]:
    """Columns that say where a payload comes from; they stay with its records where the payloads have them."""
    return [c for c in ("file", "row") if c in feeds.columns]


def is_unreadable(payload: Column) -> Column:
    """A payload that is neither JSON nor, where it begins like markup, well-formed XML."""
    broken = F.from_xml(payload, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "rowTag": "rss"})
    as_xml = broken.isNull() | broken["_corrupt_record"].isNotNull()
    return F.when(F.ltrim(payload).startswith("<"), as_xml).otherwise(F.try_parse_json(payload).isNull())


def unreadable_payloads(feeds: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Payloads, JSON or RSS, that do not parse.

    With ``settings`` only those of feed types: what ``route`` reads as a stored page need be neither JSON nor XML. A
    page that is null is unreadable all the same.
    """
    bad = F.coalesce(is_unreadable(F.col("payload")), F.lit(True))
    if settings is None:
        return feeds.filter(bad)
    return with_types(feeds, settings).filter(bad & (F.col("_type").isin(*FEED_TYPES) | F.col("payload").isNull())).drop("_type")


def unreadable(feeds: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Quarantine: payloads that do not parse, with counts per source."""
    return unreadable_payloads(feeds, settings).groupBy("source_name").agg(F.count("*").alias("n_bad"))


def _first(i, *fields) -> Column:
    return F.coalesce(*[null_if_empty(_get(i, f)) for f in fields])


def _joined(i, field: str, limit: int | None = None) -> Column:
    """A list of texts joined by commas, or a single text."""
    arr = _get(i, field, "array<string>")
    arr = F.slice(arr, 1, limit) if limit else arr
    names = F.filter(F.transform(arr, one_line), lambda t: t != "")
    return null_if_empty(F.coalesce(F.array_join(names, ", "), clean_text(_get(i, field))))


def _names(i, field: str) -> Column:
    """Names of one object, a list of objects or texts, or a text; joined by commas."""
    arr = _get(i, field, "array<variant>")
    listed = F.transform(arr, lambda v: F.coalesce(_get(v, "name"), F.try_variant_get(v, "$", "string")))
    # an object without a name also reads as JSON text; only real texts may stand in
    named = F.filter(F.transform(listed, one_line), lambda t: (t != "") & ~F.startswith(t, F.lit("{")))
    single = F.coalesce(_get(i, f"{field}.name"), F.try_variant_get(i, f"$.{field}", "string"))
    text = F.when(arr.isNotNull(), F.array_join(named, ", ")).otherwise(clean_text(single))
    return null_if_empty(text)


def _finish(rows: DataFrame, settings: DataFrame | None, **cols: Column) -> DataFrame:
    """Select the raw record; the source's default place and category fill gaps."""
    place = [c for c in ("file", "row", "pos") if "row" in rows.columns]
    out = rows.select(
        "source_name", *place,
        *[cols.get(n, F.lit(None)).cast("string").alias(n) for n in RAW_COLUMNS if n != "source_name"],
    )
    if settings is None:
        return out
    defaults = settings.select("source_name", "default_location", "default_category")
    return out.join(defaults, "source_name", "left").withColumns(
        {
            "location": F.coalesce(null_if_empty(F.col("location")), "default_location"),
            "category": F.coalesce("category", "default_category"),
        }
    ).select(*place, *RAW_COLUMNS)


def _requirements(text: Column) -> Column:
    return C.section(text, ["Requirements", "Qualifications", "Required Skills"])


def jobicy(feeds: DataFrame, settings=None) -> DataFrame:
    i = F.col("i")
    html = F.coalesce(_first(i, "jobDescription", "description", "jobExcerpt"), F.lit(""))
    link = F.coalesce(_first(i, "url", "jobUrl", "jobSlug"), F.col("url"))
    address = F.coalesce(null_if_empty(normalize_url(link, F.col("url"))), F.col("url"))
    body = html_to_text(html)
    return _finish(
        _items(feeds, "$.jobs"), settings,
        source_url=address, apply_url=address, title=_first(i, "jobTitle", "title"),
        company=_first(i, "companyName", "company"), location=clean_text(_first(i, "jobGeo", "jobRegion")),
        summary=F.coalesce(null_if_empty(body), clean_text(_get(i, "jobExcerpt"))), description_html=html,
        posted_at=C.parse_date(_first(i, "pubDate", "publishedAt")),
        department=F.coalesce(_joined(i, "jobIndustry"), _joined(i, "jobLevel"), _joined(i, "jobType")),
        employment_type=_joined(i, "jobType"), remote_status=F.lit("Remote"),
        external_id=_first(i, "id", "jobSlug"), requirements=_requirements(body),
    )


def remoteok(feeds: DataFrame, settings=None) -> DataFrame:
    i = F.col("i")
    rows = _items(feeds, "$", "$.jobs").filter(_first(i, "position", "title").isNotNull())
    html = F.coalesce(_first(i, "description", "description_html"), F.lit(""))
    address = F.coalesce(
        null_if_empty(normalize_url(_first(i, "url", "apply_url", "slug"), F.col("url"))), F.col("url")
    )
    low, high = _first(i, "salary_min"), _first(i, "salary_max")
    pay = F.when((low != "0") & (high != "0"), F.concat(F.lit("USD "), low, F.lit(" - "), high))
    body = html_to_text(html)
    return _finish(
        rows, settings,
        source_url=address, apply_url=address, title=_first(i, "position", "title"), company=_get(i, "company"),
        location=clean_text(_get(i, "location")),
        summary=F.coalesce(null_if_empty(body), F.array_join(_get(i, "tags", "array<string>"), " ")),
        description_html=html, posted_at=C.parse_date(_first(i, "date", "epoch")),
        department=_joined(i, "tags", 5), employment_type=_get(i, "type"),
        salary_range=F.coalesce(null_if_empty(clean_text(_get(i, "salary"))), pay), remote_status=F.lit("Remote"),
        external_id=_first(i, "id"), requirements=_requirements(body),
    )


def reliefweb(feeds: DataFrame, settings=None) -> DataFrame:
    i = F.col("i")
    rows = _items(feeds, "$.data").withColumn("f", F.try_variant_get("i", "$.fields", "variant")).filter("f is not null")
    f = F.col("f")
    site = F.lit("https://reliefweb.int")
    html = F.coalesce(_first(f, "$['body-html']", "body", "description"), F.lit(""))
    alias = F.coalesce(_first(f, "url_alias"), _first(i, "href"), F.col("url"))
    address = F.coalesce(null_if_empty(normalize_url(alias, site)), F.col("url"))
    first_name = lambda field: F.coalesce(
        _get(f, f"{field}[0].name"), _get(f, f"{field}.name"), F.element_at(F.split(_names(f, field), ", "), 1)
    )
    body = html_to_text(html)
    return _finish(
        rows, settings,
        source_url=address,
        apply_url=F.coalesce(null_if_empty(normalize_url(_first(f, "how_to_apply"), site)), address),
        title=_get(f, "title"), company=clean_text(F.coalesce(first_name("source"), first_name("organization"))),
        location=F.concat_ws(", ", _names(f, "city"), _names(f, "country")), summary=body, description_html=html,
        posted_at=C.parse_date(F.coalesce(_get(f, "date.created"), _get(f, "date"))),
        expires_at=C.parse_date(F.coalesce(_get(f, "date.closing"), _get(f, "$['date.closing']"))),
        department=F.coalesce(_names(f, "career_categories"), _names(f, "theme")),
        employment_type=_get(f, "career_categories[0].name"), external_id=_first(i, "id"),
        requirements=_requirements(body),
    )


def _company_of_path(url: Column, last: bool) -> Column:
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    token = F.try_element_at(parts, F.lit(-1 if last else 1))
    if not last:
        token = F.replace(F.replace(token, F.lit("job-boards"), F.lit("")), F.lit("greenhouse"), F.lit(""))
    name = F.trim(F.regexp_replace(token, "[^A-Za-z0-9]+", " "))
    return F.when(C.is_company(name), F.initcap(name))


def _source_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def greenhouse(feeds: DataFrame, settings=None) -> DataFrame:
    i = F.col("i")
    place = clean_text(F.coalesce(_get(i, "location.name"), _get(i, "location")))
    html = F.coalesce(_get(i, "content"), F.lit(""))
    link = F.coalesce(_first(i, "absolute_url"), F.col("url"))
    address = F.coalesce(null_if_empty(normalize_url(link, F.col("url"))), F.col("url"))
    body = html_to_text(html)
    return _finish(
        _items(feeds, "$.jobs"), settings,
        source_url=address, apply_url=address, title=_get(i, "title"),
        company=F.coalesce(_company_of_path(link, last=False), _source_title(F.col("source_name"))),
        location=place, summary=body, description_html=html, posted_at=C.parse_date(_get(i, "updated_at")),
        department=_names(i, "departments"), external_id=_first(i, "id"),
        remote_status=F.when(place.rlike(REMOTE_AREA), F.lit("Remote")), requirements=_requirements(body),
    )


def lever(feeds: DataFrame, settings=None) -> DataFrame:
    i = F.col("i")
    place = clean_text(_get(i, "categories.location"))
    html = F.concat_ws("\n", clean_text(_get(i, "description")), clean_text(_get(i, "descriptionPlain")))
    address = F.coalesce(
        null_if_empty(normalize_url(_first(i, "hostedUrl", "applyUrl"), F.col("url"))), F.col("url")
    )
    return _finish(
        _items(feeds, "$", "$.postings"), settings,
        source_url=address, apply_url=address, title=_get(i, "text"),
        company=F.coalesce(_company_of_path(F.col("url"), last=True), _source_title(F.col("source_name"))),
        location=place, summary=html_to_text(html), description_html=html,
        department=_get(i, "categories.team"), employment_type=_get(i, "categories.commitment"),
        external_id=_first(i, "id"),
        remote_status=F.when(F.concat(place, html).rlike(REMOTE_AREA), F.lit("Remote")),
        requirements=_requirements(html),
    )


RSS_SCHEMA = (
    "channel struct<item: array<struct<title:string, link:string, description:string, "
    "`content:encoded`:string, pubDate:string, `dc:date`:string, category:array<string>>>>"
)


def split_rss_title(title: Column) -> Column:
    """struct(company, role) of "Company: Role" or "Role at Company"."""
    t = clean_text(title)
    left = clean_text(F.regexp_extract(t, "^([^:]*):", 1))
    right = clean_text(F.regexp_extract(t, "^[^:]*:(.*)$", 1))
    at = r"(?i)^(.+?)\s+(?:at|with)\s+([A-Z0-9][A-Za-z0-9 &.'’/-]{2,80})$"
    pair = lambda company, role: F.struct(company.alias("company"), role.alias("role"))
    return (
        F.when(F.contains(t, F.lit(":")) & C.is_company(left) & (C.is_role(right) | (F.length(right) >= 5)), pair(left, right))
        .when(t.rlike(at), pair(clean_text(F.regexp_extract(t, at, 2)), clean_text(F.regexp_extract(t, at, 1))))
        .otherwise(pair(F.lit(None).cast("string"), t))
    )


def rss(feeds: DataFrame, settings=None) -> DataFrame:
    doc = feeds.withColumn(
        "_doc", F.from_xml("payload", RSS_SCHEMA, {"mode": "PERMISSIVE", "rowTag": "rss"})
    )
    rows = doc.select("source_name", "url", *_place(feeds), F.posexplode("_doc.channel.item").alias("pos", "i"))
    f = lambda n: clean_text(F.col(f"i.{n}"), keep_lines=True)
    html = F.coalesce(null_if_empty(f("description")), f("`content:encoded`"))
    cats = F.filter(F.transform("i.category", one_line), lambda t: t != "")
    body = html_to_text(html)
    area = F.lower(F.concat_ws(" ", cats, body))
    place = (
        F.when(area.rlike("anywhere in the world|worldwide|global"), F.lit("Remote / Worldwide"))
        .when(area.rlike("africa|emea|sast|south african standard time"), F.lit("Remote / Africa"))
    )
    split = split_rss_title(f("title"))
    address = F.coalesce(null_if_empty(normalize_url(f("link"), F.col("url"))), F.col("url"))
    return _finish(
        rows, settings,
        source_url=address, apply_url=address, title=F.coalesce(null_if_empty(split["role"]), f("title")),
        company=split["company"], location=place, summary=F.coalesce(null_if_empty(body), f("title")),
        description_html=html,
        posted_at=C.parse_date(F.coalesce(null_if_empty(f("pubDate")), f("`dc:date`"))),
        remote_status=F.lit("Remote"),
    )


FEED_TYPES = {
    "rss": rss, "rss_feed": rss, "jobicy_api": jobicy, "remoteok_api": remoteok,
    "reliefweb_api": reliefweb, "greenhouse_api": greenhouse, "lever_api": lever,
}


def with_types(feeds: DataFrame, settings: DataFrame) -> DataFrame:
    """Payloads with ``_type``, their source's type; generic without settings."""
    kinds = settings.select("source_name", F.lower(F.trim("type")).alias("_type"))
    kinds = F.broadcast(kinds) if few_rows(settings) else kinds
    return feeds.join(kinds, "source_name", "left").withColumn("_type", F.coalesce("_type", F.lit("generic")))


def _by_type(feeds: DataFrame, settings: DataFrame):
    """A function from a feed type (None: every other) to its payloads.

    Few sources are told apart by name, which reaches the scan of the payloads: a type reads its own and joins nothing.
    """
    if few_rows(settings):
        kinds = {}
        rows = settings.select("source_name", F.lower(F.trim("type")).alias("t")).collect()
        for r in rows:
            kinds.setdefault(r.t, []).append(r.source_name)
        known = [n for t in FEED_TYPES for n in kinds.get(t, []) if n is not None]
        if len({r.source_name for r in rows}) == len(rows):
            mine = lambda names: F.coalesce(F.col("source_name").isin(*names), F.lit(False)) if names else F.lit(False)
            return lambda kind: feeds.filter(~mine(known)) if kind is None else feeds.filter(mine([n for n in kinds.get(kind, []) if n is not None]))
    typed = with_types(feeds, settings)
    return lambda kind: typed.filter(~F.col("_type").isin(*FEED_TYPES) if kind is None else F.col("_type") == kind)


def route(feeds: DataFrame, settings: DataFrame) -> DataFrame:
    """Flatten a mix of payloads, each by its source's type.

    Feed types have their own form. Every other type, an unknown or missing one and sources without settings too, is
    read as a stored page: a detail page gives its record, a page without detail links its cards.
    """
    of = _by_type(feeds, settings)
    out = page_payloads(of(None), settings)
    for kind, flatten in FEED_TYPES.items():
        out = out.unionByName(flatten(of(kind), settings), allowMissingColumns=True)
    return out


def page_payloads(feeds: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Records of payloads that are pages."""
    keep = [*_place(feeds), "source_name", "url"]
    # payloads may repeat; each counts on its own
    pages = cut_lineage(feeds.select(*keep, F.col("payload").alias("html")).withColumn("page_id", F.monotonically_increasing_id()))
    records = page_records(pages.select("page_id", "source_name", "url", "html"))
    placed = records.drop("source_name").join(pages.drop("html"), "page_id")
    given = {c: F.col(c) for c in RAW_COLUMNS if c in records.columns and c != "source_name"}
    return _finish(placed, settings, **given)


def routing_counts(feeds: DataFrame, settings: DataFrame) -> DataFrame:
    """Per source: payloads, unreadable ones, records; every source of the payloads has a row."""
    sides = feeds.groupBy("source_name").agg(F.count("*").alias("n_payloads")), unreadable(feeds, settings), route(feeds, settings).groupBy("source_name").agg(F.count("*").alias("n_records"))
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side.withColumnRenamed("source_name", "_name"), F.col("source_name").eqNullSafe(F.col("_name")), "left").drop("_name")
    return out.select("source_name", "n_payloads", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_bad", "n_records")])
