"""Operators against brute force or a sequential statement of the rule, on small fixtures."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listmill.functions.text import content_hash
from listmill.operators import identity as I
from listmill.operators import merge as M
from listmill.operators import pages as P
from listmill.operators import resolve, scan
from listmill.operators import search as S
from listmill.plans.ingest import map_records, validate
from listmill.sources import feeds, tables
from listmill.streaming import events as E

ROW = "title string, company string, location string, summary string, source_name string, external_job_id string, source_url string, apply_url string"
TEXTS = [
    "The officer keeps stock of all tools and writes a short report each week for the team.",
    "The officer keeps stock of all tools and writes a long report each week for the team.",
    "Drive trucks between the two depots and look after the vehicle at all times.",
    "",
]


def make_rows(seed, n, hot=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        url = "https://a.example/list" if hot and rnd.random() < 0.35 else f"https://a.example/{rnd.randrange(6)}"
        rows.append(
            (i, rnd.choice(["Driver", "Nurse"]), rnd.choice(["Acme", "Delta"]), "Harare", rnd.choice(TEXTS), "s",
             rnd.choice([None, None, None, "7", "8"]), url, rnd.choice([url, f"https://b.example/{rnd.randrange(6)}"]))
        )
    return rows


def norm(s):
    return re.sub(r"\W+", " ", s.lower())


def ids_of(r):
    if r[6]:
        return [f"external:s:{r[6]}"]
    key = lambda u: u.split("//")[1]
    return [f"source:{key(r[7])}"] + ([f"apply:{key(r[8])}"] if r[8] != r[7] else [])


def sim(a, b):
    a, b = norm(a)[:2000], norm(b)[:2000]
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def sequential_dedupe(rows):
    urls, keys, out = {}, {}, []
    for r in rows:
        key, ids = (r[1], r[2], r[3]), ids_of(r)
        if any(i.startswith("external") and i in urls for i in ids) or any(urls.get(i) == key for i in ids):
            continue
        if key in keys and sim(keys[key][4], r[4]) >= 0.88:
            continue
        for i in ids:
            urls[i] = key
        keys[key] = r
        out.append(r[0])
    return out


@pytest.mark.parametrize("seed", [1])
def test_dedupe_equals_sequential_pass(spark, seed):
    rows = make_rows(seed, 40)
    df = spark.createDataFrame(rows, "ord bigint, " + ROW)
    got = sorted(r["ord"] for r in I.dedupe_batch(df, "ord").select("ord").collect())
    assert got == sequential_dedupe(rows)


def with_hash(df):
    return df.withColumn("content_hash", content_hash([F.col(c) for c in ("title", "company", "summary", "source_url")]))


@pytest.mark.parametrize("seed", [4])
def test_match_equals_scan_of_stored_rows(spark, seed):
    stored, new = make_rows(seed, 25), make_rows(seed + 100, 25)
    cur = with_hash(spark.createDataFrame(stored, "id bigint, " + ROW))
    inc = with_hash(spark.createDataFrame(new, "ord bigint, " + ROW))
    got = {r["ord"]: r["stored_id"] for r in resolve.match_existing(inc, cur, "ord").collect()}
    for n in new:
        want = None
        for s in stored:
            same_key, shared = n[1:4] == s[1:4], set(ids_of(n)) & set(ids_of(s))
            same_hash = (n[1], n[2], norm(n[4]), n[7]) == (s[1], s[2], norm(s[4]), s[7])
            if (same_hash or any(x.startswith("external") for x in shared)
                    or (shared and (same_key or sim(s[4], n[4]) >= 0.9)) or (same_key and sim(s[4], n[4]) >= 0.9)):
                want = s[0]
                break
        assert got[n[0]] == want, n


def test_merge_inserts_skips_and_updates(spark):
    row = (1, "Driver", "Acme", "Harare", TEXTS[0], "s", None, "https://a.example/1", "https://a.example/1")
    inc = with_hash(spark.createDataFrame([row], "ord bigint, " + ROW))
    empty = inc.limit(0).withColumnRenamed("ord", "id")
    first, acts = M.merge_jobs(empty, inc, "ord")
    assert [(r["action"], r["id"]) for r in acts.collect()] == [("inserted", 1)]
    again, acts = M.merge_jobs(first, inc, "ord")
    assert [r["action"] for r in acts.collect()] == ["skipped"] and again.count() == 1
    edit = with_hash(inc.drop("content_hash").withColumn("summary", F.lit(TEXTS[0] + " Soon.")))
    after, acts = M.merge_jobs(first, edit, "ord")
    assert [r["action"] for r in acts.collect()] == ["updated"]
    assert after.first()["summary"].endswith("Soon.") and after.first()["id"] == 1
    assert [r["url"] for r in M.changed_urls(acts, "https://s.example").collect()] == ["https://s.example/job/1/driver"]


def test_prior_values_and_numbering_do_not_depend_on_chunks(spark):
    rows = [("a", i, i if i % 3 == 0 else None) for i in range(50)] + [("b", i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    for size in (1, 4, 1000):
        got = {(r["g"], r["o"]): r["prev_v"] for r in scan.prior_values(df, ["g"], "o", ["v"], size).collect()}
        assert all(got["a", o] == (None if o == 0 else (o - 1) // 3 * 3) for o in range(50))
    sparse = df.filter("g = 'a'").select("o", (F.col("o") * 10**15).alias("far"), F.col("o").cast("string").alias("s"))
    for order, want in (("far", range(50)), (["s", "o"], sorted(range(50), key=str))):
        n = scan.number_rows(sparse, order, "n").collect()
        assert [r["o"] for r in sorted(n, key=lambda r: r["n"])] == list(want) and sorted(r["n"] for r in n) == list(range(1, 51))


def admitted_one_by_one(times, limit, window):
    held, out = [], []
    for t in times:
        held = [h for h in held if h > t - window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def test_admission_step():
    rnd = random.Random(9)
    times = sorted(rnd.randrange(0, 40_000) for _ in range(300))
    taken, _ = E.admit_times(np.array(times) * 1_000_000, [], 3, 900_000_000)
    want = admitted_one_by_one(times, 3, 900)
    assert [i in set(taken) for i in range(300)] == want


def test_prefix_search_rules(spark):
    rows = [(1, "Café Manager", "Acme", "x", "Harare"), (2, "Cafe manageress", "Delta", "y", "Gweru"), (3, "Decaf", "Acme", "z", "Harare")]
    jobs = spark.createDataFrame(rows, "id bigint, title string, company string, summary string, location string")
    post = S.build_postings(jobs)
    ids = lambda q: sorted(r["id"] for r in S.prefix_search(jobs, post, q).collect())
    assert ids("cafe") == [1, 2] and ids("CAFÉ acm") == [1] and ids("caf_manager") == [] and ids("cafe_manager") == [1, 2]
    assert ids("!!") == [1, 2, 3]


PAGE = (
    "<html><head><title>Acme jobs</title></head><body><nav><a href='/x'>Menu</a></nav><main><div class='share'>Share</div>"
    "<h1>Field Officer</h1><p>Company: Acme Trust<br>Location: Harare</p><div hidden>secret</div>"
    "<p>Apply by 3 June 2026. Run the <b>field</b> office.</p><a href='https://f.example/a'>Apply</a></main></body></html>"
)


def test_detail_page_to_record(spark):
    df = spark.createDataFrame([(1, "https://a.example/jobs/1", PAGE), (2, "https://a.example/x", None)], "page_id bigint, url string, html string")
    rows = P.detail_records(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["company"], r["location"], r["expires_at"]) == ("Field Officer", "Acme Trust", "Harare", "2026-06-03")
    assert r["apply_url"] == "https://f.example/a" and "secret" not in r["summary"] and "Share" not in r["summary"]


def test_feeds_and_bad_payload(spark):
    rows = [
        ("remoteok_api_src", "https://r.example/api", '[{"legal":"x"},{"id":5,"position":"Data Engineer","company":"Acme","description":"<p>Build</p>","url":"/j/5","salary_min":10,"salary_max":20,"tags":["a","b"]}]'),
        ("remoteok_api_src", "https://r.example/api", "{broken"),
    ]
    df = spark.createDataFrame(rows, "source_name string, url string, payload string")
    out = feeds.remoteok(df).collect()
    assert [(r["title"], r["source_url"], r["salary_range"], r["department"], r["external_id"]) for r in out] == [
        ("Data Engineer", "https://r.example/j/5", "USD 10 - 20", "a, b", "5")
    ]
    assert feeds.unreadable(df).first()["n_bad"] == 1
    xml = "<rss><channel><item><title>Acme Ltd: Nurse</title><link>https://w.example/1</link><pubDate>Tue, 09 Jun 2026 10:00:00 +0000</pubDate><category>Africa</category><description>&lt;p&gt;Care&lt;/p&gt;</description></item></channel></rss>"
    df = spark.createDataFrame([("w", "https://w.example", xml), ("w", "https://w.example", "<rss><chan"), ("w", "u", None), ("w", "u", " {}")], "source_name string, url string, payload string")
    assert feeds.unreadable(df).first()["n_bad"] == 2
    out = feeds.rss(df).collect()
    assert [(r["company"], r["title"], r["location"], r["posted_at"], r["summary"]) for r in out] == [("Acme Ltd", "Nurse", "Remote / Africa", "2026-06-09", "Care")]


def test_registry_defaults(spark, tmp_path):
    p = tmp_path / "sources.json"
    p.write_text('[{"name":"a","type":"rss","start_urls":["u"]},{"name":"b","enabled":false},{"name":"c","max_pages":3,"default_location":"Remote"}]')
    rows = {r["source_name"]: r for r in tables.read_sources(spark, str(p)).collect()}
    assert sorted(rows) == ["a", "c"]
    assert (rows["a"]["max_pages"], rows["a"]["max_detail"], rows["a"]["default_location"], rows["a"]["default_category"]) == (1, 40, "Zimbabwe", "Other")
    assert (rows["c"]["type"], rows["c"]["max_pages"], rows["c"]["default_location"]) == ("generic", 3, "Remote")


def test_map_and_validate(spark):
    body = "Company: Delta Foods\nRequirements\nA clean licence\nThe driver moves goods between the depots of the company and keeps the truck in good order."
    raw = spark.createDataFrame(
        [(1, "src", "https://a.example/1#x", "Truck Driver | Apply by 3 June 2026", body, "/apply/1")],
        "ord bigint, source_name string, source_url string, title string, summary string, apply_url string",
    )
    for n in ("company", "location", "category", "description_html", "posted_at", "expires_at", "department", "employment_type", "salary_range", "remote_status", "external_id", "requirements"):
        raw = raw.withColumn(n, F.lit(None).cast("string"))
    src = spark.createDataFrame(
        [("src", "Harare", "Other", None, ["Harare"], True)],
        "source_name string, default_location string, default_category string, default_company string, allowed_locations array<string>, skip_expired boolean",
    )
    r = validate(map_records(raw, src), F.lit("2026-05-01").cast("date")).first()
    assert (r["title"], r["company"], r["location"], r["expires_at"]) == ("Truck Driver", "Delta Foods", "Harare", "2026-06-03")
    assert (r["source_url"], r["apply_url"], r["requirements"].split("\n")[0]) == ("https://a.example/1", "https://a.example/apply/1", "A clean licence")
    assert r["ok"] and "Source: src" in r["summary"] and "Deadline: 2026-06-03" in r["summary"]
    late = validate(map_records(raw, src), F.lit("2026-07-01").cast("date")).first()
    assert late["reasons"] == ["expired"]


def test_pages_are_no_unreadable_payloads(spark):
    page = "<!doctype html><html><body><p>one<br>two &nbsp; <b>three</p></body></html>"
    rows = [("p", "u", page), ("p", "u", None), ("none", "u", page), ("w", "u", page), ("w", "u", "<rss></rss>"), ("j", "u", "{bro"), ("j", "u", "{}")]
    df = spark.createDataFrame(rows, "source_name string, url string, payload string")
    kinds = spark.createDataFrame([("p", "generic", None, None), ("w", " RSS", None, None), ("j", "jobicy_api", None, None)], "source_name string, type string, default_location string, default_category string")
    assert {r["source_name"]: r["n_bad"] for r in feeds.unreadable(df, kinds).collect()} == {"p": 1, "w": 1, "j": 1}
    counts = {r["source_name"]: (r["n_payloads"], r["n_bad"]) for r in feeds.routing_counts(df, kinds).collect()}
    assert counts == {"p": (2, 1), "none": (1, 0), "w": (2, 1), "j": (2, 1)}
