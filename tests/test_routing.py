"""Routing of payloads on inputs that were read wrongly, or too often, before."""

from listmill.operators import pages as P
from listmill.plans import adaptors as A
from listmill.plans import feed_queries as Q
from listmill.sources import feeds as FD


def test_a_heading_that_reads_like_a_job_title_leaves_a_listing_page(spark, tmp_path):
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>text</p></article><footer>end</footer></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(h)) for i, h in enumerate(["Verein Teacher lich", "Beverach von"])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = P.page_records(A.card_pages(spark, str(tmp_path))).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in got} == {0: 2, 1: 2}


def test_payloads_of_all_kinds_shuffle_the_texts_once_and_are_told_apart_by_name(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "src1") for i in range(45)], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    payloads = Q._all_payloads(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len({r.source_name for r in payloads.collect()}) == 6 and payloads.count() == 18
    payloads.collect()
    assert plan(payloads).count("ReusedExchange") == 5
    kinds = spark.createDataFrame([("a", " RSS"), ("b", "lever_api"), ("c", "odd"), ("d", None)], "source_name string, type string")
    rows = spark.createDataFrame([(n, "u", "{}") for n in ("a", "b", "c", "d", "e", None)], "source_name string, url string, payload string")
    of = FD._by_type(rows, kinds)
    names = lambda kind: {r.source_name for r in of(kind).collect()}
    assert [names("rss"), names("lever_api"), names("jobicy_api"), names(None)] == [{"a"}, {"b"}, set(), {"c", "d", "e", None}]
    assert "Join" not in plan(of("rss"))
    assert "SortMergeJoin" not in plan(FD.with_types(rows, kinds))
