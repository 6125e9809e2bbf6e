import re

from pyspark.sql import functions as F

from listmill.functions import classify as C
from listmill.functions import quality as Q
from listmill.functions import text as T
from listmill.functions import urls as U
from listmill.functions import vocab as V


def value(spark, make, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_clean_text_resolves_references_and_spaces(spark):
    assert value(spark, T.clean_text, " a&nbsp;&amp;lt; ​b&#39;s &#x2022;\r\n- ") == "a &lt; b's"
    assert value(spark, lambda c: T.clean_text(c, True), "a  b \r\n\n\n\n c ") == "a b\n\nc"


def test_normalize_block_drops_noise_repeats_and_gaps(spark):
    raw = "Home\nNurse needed •  Works nights\n\n\n\nNurse needed\n* Valid licence\nApply Now\n---\n---\nEnd"
    want = "Nurse needed\n• Works nights\n\n• Valid licence\n---\n---\nEnd"
    assert value(spark, T.normalize_block, raw) == want.replace("---\n---\n", "")
    assert value(spark, lambda c: T.normalize_block(c, noise=False), "a\n===\nb\n===") == "a\n===\nb\n==="


def test_schema_text_drops_repeated_punctuation_lines(spark):
    assert value(spark, T.schema_text, "a\n===\nb\n***\nA!") == "a\n===\nb"


def test_keywords_strip_plural_before_stop_words(spark):
    assert sorted(value(spark, T.keywords, "Skills and the Nurses of IT jobs")) == ["nurse", "skill"]


def test_roles_and_companies(spark):
    role = lambda c: C.is_role(T.clean_text(c))
    assert value(spark, role, "Finance Manager")
    for bad in ("Manage nurses daily", "Jobs in Harare", "Acme is hiring a Driver", "Required: driver", "abc"):
        assert not value(spark, role, bad)
    assert value(spark, C.is_company, "Delta Foods")
    for bad in ("we", "is a nurse", "Seeking staff", "A. B", "one two three four five six seven eight nine"):
        assert not value(spark, C.is_company, bad)


def test_clean_title(spark):
    clean = lambda t, c, b: C.clean_title(t, c, b)
    assert value(spark, clean, "Acme Trust is hiring: a Finance Officer | Deadline 3 June", None, None) == "Finance Officer"
    assert value(spark, clean, "Acme - Driver (Remote)", "Acme", None) == "Driver"
    assert value(spark, clean, "Great news", None, "Job Title: Registered Nurse\nmore") == "Registered Nurse"
    assert value(spark, clean, "", None, None) == "Untitled role"


def test_role_below_its_label_and_in_a_heading(spark):
    assert value(spark, C.role_from_text, "Position\n\nField Officer\n") == "Field Officer"
    assert value(spark, C.role_from_text, "Intro text\nTruck Driver – Acme Ltd\n") == "Truck Driver"


def test_company_repair(spark):
    def repair(company, body, url):
        none = F.lit(None).cast("string")
        return C.repair_company(company, none, body, F.lit("Harare, Zimbabwe"), none, url, none)

    assert value(spark, repair, "VacancyMail", "Apply to hr@delta-foods.co.zw", None) == "Delta Foods"
    assert value(spark, repair, "Vacancy Mail", "Apply to someone@gmail.com", None) is None
    assert value(spark, repair, "Vacancy Mail", "Work with Oxfam in the field", None) == "Oxfam"
    assert value(spark, repair, "Other", "Apply to hr@delta-foods.co.zw", None) is None


def test_salary_and_dates(spark):
    s = value(spark, C.salary_struct, "USD 900 - 1200 per month")
    assert (s["currency"], s["unit"], float(s["min"]), float(s["max"]), s["value"]) == ("USD", "MONTH", 900, 1200, None)
    assert value(spark, C.salary_struct, "Competitive") is None
    for text, want in [
        ("Closing date: 15 June 2026", "2026-06-15"), ("June 3, 2026", "2026-06-03"), ("2026-06-09T10:00:00Z", "2026-06-09"),
        ("rolling", None), ("Tue, 09 Jun 2026 10:00:00 +0000", "2026-06-09"), ("06/07/2026", "2026-06-07"), ("no date", None),
    ]:
        assert value(spark, C.parse_date, text) == want, text
    assert value(spark, C.deadline, "text\nApply by 1 July 2026 please") == "2026-07-01"


def test_location_category_and_status(spark):
    place = lambda v: C.location(v, F.lit(""), F.lit(""), F.lit("Zimbabwe"))
    assert value(spark, place, "Home-based, Harare") == "Remote / Zimbabwe"
    assert value(spark, place, "Hybrid in South Africa") == "Hybrid / South Africa"
    assert value(spark, place, "") == "Zimbabwe"
    cat = lambda t: C.infer_category(t, F.lit(""), F.lit("Other"))
    assert value(spark, cat, "Internal auditor") == "Private Sector"
    assert value(spark, cat, "Nursing intern") == "Internships"
    assert value(spark, cat, "Those who care") == "NGO & Development"


def test_section_stops_at_next_heading(spark):
    body = "Intro\nRequirements\nA degree\nTwo years\nHow to apply\nWrite"
    assert value(spark, lambda c: C.section(c, ["Requirements"]), body) == "A degree\nTwo years"


def test_summary_keeps_sentences_and_facts(spark):
    body = "Contents\nAbout The Role\n" + "The holder will run the district programme and report to the country director. " * 1 + "\nLocation: Harare\nLocation: Harare\nPrivacy policy"
    out = value(spark, lambda t, b: C.make_summary(t, b), "Programme Officer", body)
    assert out.split("\n")[0].startswith("The holder will run") and out.count("Location: Harare") == 1
    assert "Privacy" not in out and "Contents" not in out


def test_merged_listing(spark):
    three = "Job Title: Nurse\nJob Title: Driver\nJob Title: Clerk"
    assert value(spark, lambda t, b: Q.is_merged(t, b), "Nurse", three)
    assert not value(spark, lambda t, b: Q.is_merged(t, b), "Nurse", "Job Title: Nurse\nWork in Harare")


def test_urls(spark):
    norm = lambda c, b: U.normalize_url(c, b)
    base = "https://ex.org/a/b/list?x=1"
    for ref, want in [
        ("../c#top", "https://ex.org/a/c"), ("/d", "https://ex.org/d"), ("?page=2", "https://ex.org/a/b/list?page=2"),
        ("//y.org/z", "https://y.org/z"), ("mailto:a@b.c", ""), ("e/./f", "https://ex.org/a/b/e/f"), ("", ""),
    ]:
        assert value(spark, norm, ref, base) == want, ref
    assert value(spark, U.url_key, "HTTP://Ex.org/Job/1/?b=2&utm_source=x&a=1#t") == "ex.org/job/1?a=1&b=2"
    assert value(spark, U.url_key, "ftp://ex.org") == ""
    public = lambda c: U.public_url(c, "https://site.example")
    assert value(spark, public, "/job/1") == "https://site.example/job/1"
    for bad in ("/admin", "/admin/x", "/job/1?x=1", "https://other.example/job/1", "", "/api/jobs", "//admin"):
        assert value(spark, public, bad) is None, bad
    assert value(spark, public, "/healthy-jobs") is None      # a private prefix without a closing slash
    assert value(spark, public, "/apiary") == "https://site.example/apiary"
    red = value(spark, U.redact_url, "https://h.x/p?Token=abc&q=1#f")
    assert red == "https://h.x/p?Token=%5Bredacted%5D&q=1"


def test_null_if_empty_evaluates_its_text_once_inside_a_lambda(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(
        T.bind(F.col("t"), lambda x: T.null_if_empty(F.regexp_replace(x, "zz", "y"))).alias("x")
    )
    assert [r.x for r in df.collect()] == ["a b", None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_runs_of_white_space_and_signs_as_the_whole_sets(spark):
    texts = ["a b", " a", "a  b", "a \tb", "a\u00a0b", "a \u2003b", "a \u00e9", "\u00e9 a", "a - b", "a -b", "a _b", "1 2", " ", "a ", "", "\n \na", "x\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for new, old in ((T.WS_RUN, T.WS + "+"), (T.NON_WORD_RUN, T.NON_WORD), (T.BLANK_RUN, r"[ \t\f\x0B]+")):
        rows = df.select("t", F.regexp_replace("t", new, " ").alias("a"), F.regexp_replace("t", old, " ").alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


ODD_TEXTS = [
    "", " ", "\n", "a\n\n\n\nb", "a  b\n c", "a \n b", "x\ty\x0bz", "a\x1cb\n\x1f\nc", "a\x85b", "a  b 　", " a​﻿b\r\nc\rd",
    "&amp;nbsp;x&#65;&nbsp; y", "one • two • three", "• Home", "- | Menu |", "Latest  Jobs", "12 jobs found", "Category: x", "* Showing\t3 jobs", "***",
    "subscribe now", "NGO Jobs", "Employer Login", "Remote & International", "Private  Sector", "Internships", "Save job\nText that stays here", "é  home", "\x01\x7f", "Homes",
]


def test_texts_that_need_no_pattern_come_out_as_by_the_patterns(spark):
    def by_patterns(c):
        t = T.unescape(T.empty_if_null(c))
        for sign, other in ((" ", " "), ("​", ""), ("﻿", ""), ("\r\n", "\n"), ("\r", "\n")):
            t = F.replace(t, F.lit(sign), F.lit(other))
        return t

    def lines_by_patterns(c):
        t = F.regexp_replace(by_patterns(c), r"[ \t\f\x0B]+", " ")
        t = F.regexp_replace(T.strip(t), f"{T.WS_IN_LINE}*\n{T.WS_IN_LINE}*", "\n")
        return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(T.EDGE))

    def noise_by_patterns(x):
        bare = F.btrim(F.regexp_replace(F.regexp_replace(x, r"^[•\-*]\s*", ""), T.WS + "+", " "), F.lit(T.EDGE))
        return (bare == "") | bare.isin(V.INFERRED_CATEGORIES) | bare.rlike("(?i)" + V.NOISE_LINE) | bare.rlike("(?i)" + V.CATEGORY_HEADING_LINE)

    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in [*ODD_TEXTS, *map(" \n".join, zip(ODD_TEXTS, ODD_TEXTS[7:]))]], "t string").select(
        "t", F.array(T.plain(c), T.clean_text(c, keep_lines=True)).alias("a"), F.array(by_patterns(c), lines_by_patterns(c)).alias("b"),
        F.array(T.is_noise_line(c), T.is_blank(c)).alias("d"), F.array(noise_by_patterns(c), T.inline(c) == "").alias("e"),
        T.one_line_of(c, c).alias("f"), T.one_line(c).alias("g"),
    ).collect()
    for r in rows:
        assert (r.a, r.d, r.f) == (r.b, r.e, r.g), r.t
    assert sum(r.d[0] for r in rows) > 10 and sum(not r.d[0] for r in rows) > 10


def test_every_noise_line_begins_with_a_known_word():
    starts = re.compile("(?i)(?:" + "|".join([r"\(\?:\\d", *V.NOISE_STARTS]) + ")")
    for part in re.split(r"\|(?![^(]*\))", re.sub(r"^\^\(\?:|\)\$$", "", V.NOISE_LINE)):
        assert starts.match(part), part
    assert all(starts.match(x) for x in V.INFERRED_CATEGORIES)


def test_lines_with_one_role_are_not_searched_for_page_chrome(spark):
    """The test of page chrome may stand only behind that of two roles."""
    df = spark.createDataFrame([("Nurse", "Job Title: Nurse\nWork in Harare")], "t string, b string").select(Q.is_merged(F.col("t"), F.col("b")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    chrome = plan.rindex("latest jobs)\\b)")
    assert ">= 2" in plan[:chrome]


def test_a_posting_makes_its_description_once(spark):
    from listmill.operators import publish as P

    names = ["title", "company", "location", "tags", "expires_at", "posted_at", "job_description", "summary", "employment_type", "salary_range", "remote_status"]
    values = ["Nurse", "Acme", "Harare, Zimbabwe", "", None, "2024-01-15", "First.\n\nSecond.", "s", "Full-time", "", "On-site"]
    df = spark.createDataFrame([(1, *values), (2, *values[:6], " ", " ", *values[8:])], "id long, " + ", ".join(f"{n} string" for n in names))
    df = df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    rows = P.posting_columns(df, F.lit("2024-07-01").cast("date"))
    assert [(r.id, r.description) for r in rows.collect()] == [(1, "<p>First.</p><p>Second.</p>")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("<p>") == 1
