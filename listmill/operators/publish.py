"""Published outputs: posting documents, sitemap, feed, outbound links."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import vocab as V
from ..functions.quality import closed_strict, is_public
from ..functions.text import (
    empty_if_null, inline, is_blank, normalize_block, null_if_empty, schema_text, slug, strip_source, to_paragraphs,
)
from ..functions.urls import job_path, safe_url, with_default_params
from .pages import html_to_text
from .search import active, order_newest


def description_html(description: Column, summary: Column, requirements: Column) -> Column:
    """Body and requirements as safe paragraphs, without source notes."""

    def text_of(c):
        marked = F.contains(c, F.lit("<")) & c.rlike("<[A-Za-z/][^>]*>")
        return F.when(~is_blank(c), strip_source(F.when(marked, html_to_text(c)).otherwise(schema_text(c))))

    body = F.coalesce(null_if_empty(empty_if_null(description)), summary)
    parts = F.array_compact(F.array(null_if_empty(text_of(body)), null_if_empty(text_of(requirements))))
    return to_paragraphs(F.array_join(parts, "\n\n"))


def posting_columns(
    jobs: DataFrame, as_of_date: Column, default_country_code="ZW", default_applicant_country="Zimbabwe"
) -> DataFrame:
    """Flat parts of the posting document for open rows that have every required part."""
    get = lambda n: F.col(n) if n in jobs.columns else F.lit(None).cast("string")
    created = F.date_format("created_at", "yyyy-MM-dd")
    posted = F.coalesce(null_if_empty(empty_if_null(get("posted_at"))), created)
    company = inline(get("company"))
    loc = inline(get("location"))
    place = C.physical_place(loc)
    # exploded from an array of one: the filter below would else be moved before the projection and make the text again
    made = description_html(get("job_description"), get("summary"), get("requirements"))
    rows = jobs.filter(~closed_strict(get("tags"), get("expires_at"), as_of_date)).select(
        *jobs.columns, F.explode(F.array(made)).alias("_description")
    )
    rows = rows.select(
        "id",
        inline(get("title")).alias("title"),
        F.col("_description").alias("description"),
        F.date_format(C.iso_date(posted), "yyyy-MM-dd").alias("date_posted"),
        F.date_format(C.iso_date(get("expires_at")), "yyyy-MM-dd").alias("valid_through"),
        company.alias("company"),
        F.when(F.lower(company) == "confidential", F.lit("confidential")).otherwise(company).alias("organisation"),
        F.coalesce(null_if_empty(inline(get("external_job_id"))), F.col("id").cast("string")).alias("identifier"),
        C.employment_codes(get("employment_type")).alias("employment_codes"),
        C.salary_struct(get("salary_range")).alias("salary"),
        C.is_fully_remote(get("remote_status"), loc).alias("remote"),
        C.applicant_area(loc, default_applicant_country).alias("applicant_area"),
        null_if_empty(C.country_code(place, default_country_code)).alias("country"),
        F.when(place != "", C.locality(place)).alias("locality"),
    )
    placed = F.when(F.col("remote"), F.col("applicant_area").isNotNull()).otherwise(
        F.col("country").isNotNull() | F.col("locality").isNotNull()
    )
    full = (F.col("title") != "") & (F.col("description") != "") & (F.col("company") != "")
    return rows.filter(full & F.col("date_posted").isNotNull() & placed)


def posting_documents(jobs: DataFrame, as_of_date: Column, base_url: str = "", **defaults) -> DataFrame:
    """(id, document): schema.org JobPosting JSON per open listing, empty parts left out."""
    p = posting_columns(jobs, as_of_date, **defaults)
    c = F.col
    typed = lambda t, *fields: F.struct(F.lit(t).alias("@type"), *fields)
    codes = c("employment_codes")
    # one code is written as a string, several as a list
    employment = F.when(F.size(codes) == 1, F.to_json(F.struct(F.get(codes, F.lit(0)).alias("employmentType")))).when(
        F.size(codes) > 1, F.to_json(F.struct(codes.alias("employmentType")))
    )
    number = lambda n: c(f"salary.{n}").cast("double")
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        c("title"), c("description"), c("date_posted").alias("datePosted"), F.lit(False).alias("directApply"),
        typed("Organization", c("organisation").alias("name")).alias("hiringOrganization"),
        typed("PropertyValue", c("company").alias("name"), c("identifier").alias("value")).alias("identifier"),
        c("valid_through").alias("validThrough"),
        F.when(
            c("salary").isNotNull(),
            typed(
                "MonetaryAmount", c("salary.currency").alias("currency"),
                typed(
                    "QuantitativeValue", c("salary.unit").alias("unitText"), number("min").alias("minValue"),
                    number("max").alias("maxValue"), number("value").alias("value"),
                ).alias("value"),
            ),
        ).alias("baseSalary"),
        F.when(c("remote"), F.lit("TELECOMMUTE")).alias("jobLocationType"),
        F.when(
            c("remote"),
            F.struct(c("applicant_area.type").alias("@type"), c("applicant_area.name").alias("name")),
        ).alias("applicantLocationRequirements"),
        F.when(
            ~c("remote"),
            typed(
                "Place",
                typed(
                    "PostalAddress", c("country").alias("addressCountry"), c("locality").alias("addressLocality")
                ).alias("address"),
            ),
        ).alias("jobLocation"),
        (
            F.concat(F.lit(base_url.rstrip("/")), job_path(c("id"), c("title"), slug))
            if base_url else F.lit(None).cast("string")
        ).alias("url"),
    )
    text = F.to_json(doc)
    merged = F.when(
        employment.isNotNull(),
        F.concat(F.expr("substr(_doc, 1, length(_doc) - 1)"), F.lit(","), F.substr(employment, F.lit(2))),
    ).otherwise(F.col("_doc"))
    return p.withColumn("_doc", text).select("id", merged.alias("document"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select(F.col("document").alias("value")).write.mode("errorifexists").text(path)


def sitemap(jobs: DataFrame, as_of_date: Column, base_url: str) -> DataFrame:
    """loc, lastmod, changefreq, priority of the fixed pages and every public listing."""
    spark = jobs.sparkSession
    base = base_url.rstrip("/")
    fixed = [("/", "daily", "1.0"), ("/services", "monthly", "0.5"), ("/post", "monthly", "0.6")]
    fixed += [(f"/jobs/{p[0]}/", "daily", "0.8") for p in V.LANDING_PAGES]
    fixed += [(f"/resources/{p}", "monthly", "0.4") for p in V.RESOURCE_PAGES]
    pages = spark.createDataFrame([(base + p, c, r) for p, c, r in fixed], "loc string, changefreq string, priority string")
    rows = jobs.filter(active(as_of_date))
    posted = F.col("posted_at") if "posted_at" in jobs.columns else F.lit(None).cast("string")
    rows = rows.filter(is_public(rows, as_of_date)).select(
        F.concat(F.lit(base), job_path(F.col("id"), F.col("title"), lambda c: slug(c, markup=True))).alias("loc"),
        F.substring(
            F.coalesce(null_if_empty(empty_if_null(posted)), F.date_format("created_at", "yyyy-MM-dd")), 1, 10
        ).alias("lastmod"),
        F.lit("weekly").alias("changefreq"), F.lit("0.7").alias("priority"),
    )
    return pages.select("loc", F.lit(None).cast("string").alias("lastmod"), "changefreq", "priority").unionByName(rows)


def feed(jobs: DataFrame, as_of_date: Column, base_url: str, n: int = V.FEED_SIZE) -> DataFrame:
    """The newest n open listings, then the public test, as feed items."""
    base = base_url.rstrip("/")
    rows = jobs.filter(active(as_of_date)).orderBy(*order_newest()).limit(n)
    return rows.filter(is_public(rows, as_of_date)).select(
        "id",
        F.concat_ws(" — ", "title", "company").alias("title"),
        F.concat(F.lit(base), job_path(F.col("id"), F.col("title"), lambda c: slug(c, markup=True))).alias("link"),
        normalize_block(F.col("summary"), max_chars=12000).alias("description"),
        F.concat(F.lit(f"{base}/job/"), F.col("id").cast("string")).alias("guid"),
    )


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).mode("errorifexists").save(path)


def tracking_url(url: Column, offer_category: Column, placement: Column, tracking_id: Column) -> Column:
    """Outbound offer link with tracking parameters, or null for an unsafe link."""
    made = with_default_params(
        inline(url),
        [
            ("utm_source", F.lit("job_board")), ("utm_medium", F.lit("affiliate")),
            ("utm_campaign", F.coalesce(offer_category, F.lit("affiliate"))), ("utm_content", placement),
            ("tracking_id", null_if_empty(empty_if_null(tracking_id))),
        ],
    )
    return F.when(safe_url(url), made)

