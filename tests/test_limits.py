"""Inputs that used to end a job or hit a cap."""

from pyspark.sql import functions as F

from listmill.operators import html_pass, pages, similar
from listmill.plans.ingest import map_records


def test_many_tags_in_a_row_are_one_break(spark):
    html = "<p>one</p>" + "<b></b>" * 5000 + "two"
    assert spark.range(1).select(pages.html_to_text(F.lit(html)).alias("t")).first().t.split() == ["one", "two"]


def test_deep_pages_are_read():
    text, _ = html_pass.read_page("<main>" + "<p>x" * 5000 + "<div hidden><div>y</div>SECRET</div>end</main>")
    assert text.split().count("x") == 5000 and "end" in text and "SECRET" not in text


def test_references_of_main_text_are_resolved_once_and_only_when_complete(spark):
    html = "<article><h1>R&amp;D</h1><p>a&amp</p><p>x &amp;lt; y &eacute; &Eacute; &#65;</p><a class='title' href='/j?a=1&amp;b=2'>Q&amp;A</a></article>"
    tree = pages.read_tree(spark.createDataFrame([(1, "https://a.example/x", html)], "page_id int, url string, html string"))
    lines = [t for t in pages.page_text(tree).first().text.split("\n") if t]
    assert lines == ["R&D", "a&amp", "x &lt; y é É A", "Q&A"]
    card = html_pass.describe_card(1, next(html_pass_root(html).walk()), {})
    assert card["links"] == [{"href": "/j?a=1&b=2", "text": "Q&A"}] and "R&D" in card["text"]


def html_pass_root(html):
    builder = html_pass.TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def test_more_viewed_listings_than_one_scan_takes(spark):
    n = 266
    jobs = spark.range(n).select(
        "id", F.concat(F.lit("Role "), F.col("id") % 7).alias("title"), F.lit("Other").alias("category"), F.lit(False).alias("featured"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("").alias("tags"), F.lit("").alias("summary"), F.lit("").alias("location"),
    )
    got = similar.similar(jobs, jobs, F.lit("2024-01-02").cast("date"), k=2, public_only=False)
    assert got.groupBy("id").count().where("count = 2").count() == n


def test_mapped_records_carry_the_batch_time(spark):
    raw = spark.createDataFrame(
        [("Driver", "Acme", "Harare", None, "s", None, "https://a.example/1", None, "Drives the truck between depots every day.", None)],
        "title string, company string, location string, category string, source_name string, external_id string, source_url string, apply_url string, summary string, description_html string",
    )
    for c in ("department", "employment_type", "salary_range", "remote_status", "requirements", "posted_at", "expires_at"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    sources = spark.createDataFrame(
        [("s", None, None, None, None, True)],
        "source_name string, default_location string, default_category string, default_company string, allowed_locations array<string>, skip_expired boolean",
    )
    at = F.lit("2024-05-01 10:00:00").cast("timestamp")
    row = map_records(raw, sources, at).first()
    assert str(row.created_at) == str(row.scraped_at) == "2024-05-01 10:00:00"


def test_page_pass_hands_on_small_parts_and_leaves_no_trees():
    import gc

    import pyarrow as pa

    html = "<main><p>a</p><div class='job-card'><h2>Nurse</h2><p>" + "plans for the whole team " * 3 + "</p></div></main>"
    own = [[("job_cards", ".mine")], None]
    batch = pa.record_batch({"page_id": list(range(500)), "html": [html, None] * 250, "selectors": pa.array(own * 250, pa.map_(pa.string(), pa.string()))})
    gc.collect()
    gc.disable()
    try:
        parts = list(html_pass.read_pages([batch]))
        left = gc.collect()
    finally:
        gc.enable()
    assert left < 500 and max(p.num_rows for p in parts) <= 200
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(500)) and rows[0].keys() == {"page_id", "main_text", "error", "cards"}
    assert [len(r["cards"]) for r in rows[:2]] == [1, 0] and rows[0]["cards"][0]["titles"] == ["Nurse"] and rows[1]["main_text"] == ""
