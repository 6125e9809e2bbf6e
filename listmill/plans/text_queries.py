"""Text normalisation, extraction and classification columns over whole texts."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions import vocab as V
from ..operators.reports import dropped_lines
from ..operators.reports import line_stats as corpus_line_stats
from ..operators.reports import repeated_lines as repeated_corpus_lines
from . import adaptors as A
from . import duck as D
from .registry import query


@query("clean_text", f"SELECT doc_id, md5({D.clean('text')}) AS one_line, md5({D.clean('text', True)}) AS with_lines FROM documents")
def clean_text(spark, sf_dir):
    docs = A.texts(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(T.clean_text(F.col("text"))).alias("one_line"),
        F.md5(T.clean_text(F.col("text"), keep_lines=True)).alias("with_lines"),
    )


@query(
    "line_dedupe",
    A.with_views(*D.block_ctes("b", "documents", "text"))
    + f"SELECT doc_id, length(block) AS n_chars, md5(block) AS digest, md5({D.cut_at_word('block', 260)}) AS short FROM b",
)
def line_dedupe(spark, sf_dir):
    """Block cleaner: noise and repeated lines out, blank runs collapsed."""
    rows = A.texts(spark, sf_dir, "documents").select("doc_id", T.normalize_block(F.col("text")).alias("block"))
    return rows.select(
        "doc_id", F.length("block").cast("bigint").alias("n_chars"), F.md5("block").alias("digest"),
        F.md5(T.cut_at_word(F.col("block"), 260)).alias("short"),
    )


def _schema_sql():
    t = D.rx(D.plain("text"), r"[ \t\f\x0B]+", " ")
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: {D.strip('x')})"
    kept = "list_filter(_l, lambda x, i: x = '' OR list_position(_k, _k[i]) = i OR (_k[i] = '' AND len(list_filter(_l[1:i-1], lambda y: y <> '' AND " + D.fold("y") + " = '')) = 0))"
    return A.with_views(
        f"l AS (SELECT doc_id, {lines} AS _l FROM documents)",
        f"k AS (SELECT *, list_transform(_l, lambda x: {D.fold('x')}) AS _k FROM l)",
    ) + f"SELECT doc_id, md5({D.join_block(kept)}) AS digest FROM k"


@query("schema_text", _schema_sql())
def schema_text(spark, sf_dir):
    """Cleaner of the published text: repeated punctuation lines go too."""
    return A.texts(spark, sf_dir, "documents").select("doc_id", F.md5(T.schema_text(F.col("text"))).alias("digest"))


@query("safe_paragraphs")
def safe_paragraphs(spark, sf_dir):
    """Text as escaped HTML paragraphs, source notes dropped."""
    text = F.concat(F.col("text"), F.lit("\n\nSource: feed"))
    return A.texts(spark, sf_dir, "documents").select("doc_id", T.to_paragraphs(T.strip_source(text)).alias("html"))


@query(
    "repeated_lines",
    A.with_views(f"l AS (SELECT doc_id, unnest({D.block_lines('text')}) AS line FROM documents)", f"k AS (SELECT doc_id, {D.fold('line')} AS line_key FROM l)")
    + "SELECT doc_id, line_key, count(*) AS n FROM k WHERE line_key <> '' GROUP BY ALL HAVING count(*) > 1",
)
def repeated_lines(spark, sf_dir):
    """Lines that one record holds more than once."""
    return dropped_lines(A.texts(spark, sf_dir, "documents"), "doc_id", "text")


_LINES = f"l AS (SELECT doc_id, unnest({D.block_lines('text')}) AS line, unnest(range(len({D.block_lines('text')}))) AS pos FROM documents), k AS (SELECT *, {D.fold('line')} AS line_key FROM l)"


@query(
    "line_stats",
    A.with_views(_LINES)
    + "SELECT line_key, count(*) AS n_lines, count(DISTINCT doc_id) AS n_rows, arg_min(doc_id, doc_id * 1000000 + pos) AS first_row, arg_min(pos, doc_id * 1000000 + pos) AS first_pos, "
    "arg_min(line, doc_id * 1000000 + pos) AS first_line FROM k WHERE line_key <> '' GROUP BY 1 HAVING count(*) > 1",
)
def line_stats(spark, sf_dir):
    """Lines that occur more than once in all records together, with their counts and first place."""
    return repeated_corpus_lines(corpus_line_stats(A.texts(spark, sf_dir, "documents"), "doc_id", "text"))


_PHRASES = ["3 June", "June 3rd", "the 15th of May", "June 2023", "5 Aug 23", "Friday", "Wednesday 10:30", "4/9", "2023", "November", "31st", "by 17:00 on 12 October"]
_PHRASE = A._pick_expr(_PHRASES, "doc_id % 12")
_READ = ["2024-06-03", "2024-06-03", "2024-05-15", "2023-06-01", "2023-08-05", "2024-07-05", "2024-07-03", "2024-04-09", "2023-07-01", "2024-11-01", "2024-07-31", "2024-10-12"]


@query("fuzzy_dates", f"SELECT doc_id, {A._pick_expr(_READ, 'doc_id % 12')} AS day FROM documents")
def fuzzy_dates(spark, sf_dir):
    """Deadline texts that name only parts of a date, filled from the day of the run."""
    text = F.concat(F.lit("Deadline: "), F.expr(_PHRASE), F.lit("\n"), F.col("text"))
    return A.texts(spark, sf_dir, "documents").select("doc_id", C.deadline(text, A.as_of_date()).alias("day"))


@query("slug", A.with_views(A.JOBS_SQL) + f"SELECT id, {D.slug('title')} AS slug, {D.slug('source_url')} AS url_slug FROM jobs")
def slug(spark, sf_dir):
    return A.jobs(spark, sf_dir).select(
        "id", T.slug(F.col("title")).alias("slug"), T.slug(F.col("source_url")).alias("url_slug")
    )


def _meta_sql():
    t, c, lo = D.inline("title"), D.inline("company"), D.inline("location")
    intro = f"({t} || ' at ' || {c} || ' - ' || {lo})"
    body = D.inline(D.cut_at_word("block", 260))
    d = f"({intro} || CASE WHEN {body} <> '' THEN '. ' || {body} ELSE '' END)"
    cut = f"rtrim(regexp_replace(substr(d, 1, 161), ' [^ ]*$', ''), '.,;:-')"
    return A.with_views(A.JOBS_SQL, *D.block_ctes("b", "jobs", "job_description"), f"m AS (SELECT id, {d} AS d FROM b)") + (
        f"SELECT id, CASE WHEN length(d) <= 160 THEN d ELSE coalesce(nullif({cut}, ''), rtrim(substr(d, 1, 160))) END AS description FROM m"
    )


@query("meta_description", _meta_sql())
def meta_description(spark, sf_dir):
    c = F.col
    return A.jobs(spark, sf_dir).select(
        "id", T.meta_description(c("title"), c("company"), c("location"), c("job_description")).alias("description")
    )


def hash_sql(cols):
    parts = ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN lower({D.clean(c)}) END" for c in cols)
    return f"sha256({D.rx(f'concat_ws({D.q(chr(124))}, {parts})', D.NON_WORD, ' ')})"


_HASHED = ["title", "company", "location", "summary"]


@query("content_hash", A.with_views(A.JOBS_SQL) + f"SELECT id, {hash_sql(_HASHED)} AS content_hash FROM jobs")
def content_hash(spark, sf_dir):
    return A.jobs(spark, sf_dir).select("id", T.content_hash([F.col(c) for c in _HASHED]).alias("content_hash"))


@query(
    "keyword_sets",
    f"WITH k AS (SELECT doc_id, {D.keywords('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_words, md5({D.set_text('w')}) AS words FROM k",
)
def keyword_sets(spark, sf_dir):
    rows = A.texts(spark, sf_dir, "documents").select("doc_id", T.keywords(F.col("text")).alias("w"))
    return rows.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("words")
    )


def _tags_sql(c):
    parts = f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[,;|]'), lambda t: {D.strip('t')}), lambda t: t <> '')[1:8]"
    keys = f"list_filter(list_distinct(list_transform({parts}, lambda t: {D.set_text(D.keywords('t'))})), lambda k: k <> '')"
    return parts, keys


_PARTS, _KEYS = _tags_sql("tags")


@query(
    "tag_sets",
    A.with_views(A.JOBS_SQL) + f"SELECT id, array_to_string({_PARTS}, '|') AS tags, array_to_string(list_sort({_KEYS}), '|') AS tag_keys FROM jobs",
)
def tag_sets(spark, sf_dir):
    return A.jobs(spark, sf_dir).select(
        "id", F.array_join(T.tag_list(F.col("tags")), "|").alias("tags"),
        F.array_join(F.array_sort(T.tag_keys(F.col("tags"))), "|").alias("tag_keys"),
    )


def category_sql(text, default="'Private Sector'"):
    cases = [(D.hit(text, r"(^|[^a-z0-9])(" + "|".join(t) + r")($|[^a-z0-9])", ""), D.q(k)) for k, t in V.CATEGORY_TERMS.items()]
    return D.first_of(cases, default)


@query(
    "category_rules",
    A.with_views(A.JOBS_SQL, f"i AS (SELECT id, category AS raw, {category_sql('lower(title || chr(32) || location || chr(10) || job_description)')} AS found FROM jobs)")
    + "SELECT id, found AS inferred, CASE WHEN found IN ('Remote & International', 'Internships') THEN found WHEN raw = 'Gigs' THEN found ELSE raw END AS category FROM i",
)
def category_rules(spark, sf_dir):
    c = F.col
    default = F.lit("Other")
    return A.jobs(spark, sf_dir).select(
        "id",
        C.infer_category(c("title"), F.concat_ws("\n", "location", "job_description"), default).alias("inferred"),
        C.category(c("category"), c("title"), c("location"), c("job_description"), default).alias("category"),
    )


@query(
    "category_of_texts",
    f"SELECT doc_id, {category_sql('lower(text)')} AS category FROM documents",
)
def category_of_texts(spark, sf_dir):
    """Categories inferred from bare document texts."""
    docs = A.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", C.infer_category(F.lit(None).cast("string"), F.col("text"), F.lit("Other")).alias("category"))


@query(
    "employment_type",
    A.with_views(A.JOBS_SQL, "e AS (SELECT id, coalesce(employment_type, '') || ' ' || job_description AS t FROM jobs)")
    + "SELECT id, " + D.first_of([(D.word("t", [t]), D.q(v)) for t, v in V.EMPLOYMENT_TERMS]) + " AS employment FROM e",
)
def employment_type(spark, sf_dir):
    text = F.concat(T.empty_if_null(F.col("employment_type")), F.lit(" "), "job_description")
    return A.jobs(spark, sf_dir).select("id", C.employment_type(text).alias("employment"))


@query(
    "remote_status",
    A.with_views(A.JOBS_SQL, "e AS (SELECT id, lower(location || ' ' || job_description) AS t FROM jobs)")
    + "SELECT id, " + D.first_of([(f"contains(t, {D.q(t)})", D.q(v)) for t, v in V.WORKPLACE_TERMS], "'On-site'") + " AS workplace FROM e",
)
def remote_status(spark, sf_dir):
    return A.jobs(spark, sf_dir).select("id", C.remote_status(F.col("location"), F.col("job_description")).alias("workplace"))


def _location_sql():
    t = D.clean("location || ' ' || title || ' ' || substr(job_description, 1, 900)")
    remote, hybrid = D.hit("t", V.REMOTE_HINT), D.hit("t", "hybrid")
    cases = [
        (f"{remote} AND {D.hit('t', V.REMOTE_COUNTRY_HINT)}", "'Remote / Zimbabwe'"),
        (f"{remote} AND {D.hit('t', V.REMOTE_REGION_HINT)}", "'Remote / Africa'"),
        (remote, "'Remote'"),
        *[(f"{hybrid} AND {D.word('t', [p])}", D.q(f"Hybrid / {p}")) for p in V.HYBRID_PLACES],
        (hybrid, "'Hybrid'"),
        *[(D.word("t", [p]), D.q(p)) for p in V.NAMED_PLACES],
    ]
    return A.with_views(A.JOBS_SQL, f"l AS (SELECT id, {t} AS t, {D.clean('location')} AS raw FROM jobs)") + (
        "SELECT id, " + D.first_of(cases, "coalesce(nullif(raw, ''), 'Zimbabwe')") + " AS place FROM l"
    )


@query("location_rules", _location_sql())
def location_rules(spark, sf_dir):
    c = F.col
    return A.jobs(spark, sf_dir).select(
        "id", C.location(c("location"), c("title"), c("job_description"), F.lit("Zimbabwe")).alias("place")
    )


@query("iso_dates", A.with_views(A.JOBS_SQL) + f"SELECT id, strftime({D.iso_day('expires_at')}, '%Y-%m-%d') AS day FROM jobs")
def iso_dates(spark, sf_dir):
    return A.jobs(spark, sf_dir).select("id", F.date_format(C.iso_date(F.col("expires_at")), "yyyy-MM-dd").alias("day"))


def labelled_sql(c, labels, n=160):
    vals = [D.clean(D.group(c, r"(?im)^\s*(?:[•\-*]\s*)?" + lab + r"\s*:?\s*([^\n]+)", 1, "")) for lab in labels]
    return "coalesce(" + ", ".join(f"CASE WHEN {v} <> '' AND length({v}) <= {n} THEN {v} END" for v in vals) + ")"


@query(
    "labelled_values",
    A.with_views(A.JOBS_SQL, f"b AS (SELECT id, {D.clean('job_description', True)} AS body FROM jobs)")
    + f"SELECT id, {labelled_sql('body', V.DEPARTMENT_LABELS)} AS department, {labelled_sql('body', V.COMPANY_LABELS)} AS company, "
    f"{labelled_sql('body', V.SALARY_LABELS)} AS salary FROM b",
)
def labelled_values(spark, sf_dir):
    b = F.col("job_description")
    return A.jobs(spark, sf_dir).select(
        "id", C.labelled(b, V.DEPARTMENT_LABELS).alias("department"), C.labelled(b, V.COMPANY_LABELS).alias("company"),
        C.labelled(b, V.SALARY_LABELS).alias("salary"),
    )


@query(
    "repeated_label_values",
    A.with_views(A.JOBS_SQL, "b AS (SELECT id, job_description || chr(10) || 'Vacancy: ' || category AS body FROM jobs)", *D.block_ctes("c", "b", "body"))
    + "SELECT id, array_to_string(list_filter([" + ", ".join(
        "CASE WHEN len(list_distinct(list_filter(list_transform(regexp_extract_all(block, "
        + D.q(r"(?im)^\s*(?:[•\-*]\s*)?" + lab + r"\s*:?\s*([^\n]{2,140})") + ", 1), lambda x: " + D.fold("x") + "), lambda x: x <> ''))) > 1 THEN " + D.q(lab) + " END"
        for lab in V.MERGED_TITLE_LABELS + ["Company"]
    ) + "], lambda x: x IS NOT NULL), ',') AS labels FROM c",
)
def repeated_label_values(spark, sf_dir):
    body = T.normalize_block(F.concat("job_description", F.lit("\nVacancy: "), "category"))
    rows = A.jobs(spark, sf_dir).select("id", body.alias("block"))
    return rows.select("id", F.array_join(C.repeated_labels(F.col("block"), V.MERGED_TITLE_LABELS + ["Company"]), ",").alias("labels"))


_NUMS = "list_transform(regexp_extract_all(t, '(\\d+(?:,\\d{3})*(?:\\.\\d+)?)', 1), lambda n: cast(replace(n, ',', '') AS double))"
_CUR = D.first_of(
    [(D.hit("t", r"(^|[^\p{L}\p{N}_])(usd($|[^\p{L}\p{N}_])|us\$|us\s+dollars?)"), "'USD'"), (D.word("t", ["eur"]) + " OR contains(t, '€')", "'EUR'"),
     (D.word("t", ["gbp"]) + " OR contains(t, '£')", "'GBP'"), (D.word("t", ["zar"]), "'ZAR'")]
)
_UNIT = D.first_of(
    [(D.hit("t", r"/\s*hour|per\s+hour|hourly"), "'HOUR'"), (D.hit("t", r"/\s*day|per\s+day|daily"), "'DAY'"),
     (D.hit("t", r"/\s*week|per\s+week|weekly"), "'WEEK'"), (D.hit("t", r"/\s*month|per\s+month|monthly"), "'MONTH'"),
     (D.hit("t", r"/\s*year|per\s+year|annually|annual|per\s+annum"), "'YEAR'")]
)
_SPAN = "(len(n) >= 2 AND (" + D.word("t", ["to", "through"]) + " OR regexp_matches(t, '[-–—]')))"


@query(
    "salary_struct",
    A.with_views(A.JOBS_SQL, f"s AS (SELECT id, {D.inline('salary_range')} AS t FROM jobs)", f"p AS (SELECT id, t, {_CUR} AS currency, {_UNIT} AS unit, {_NUMS} AS n FROM s)")
    + f"SELECT id, currency, unit, CASE WHEN {_SPAN} THEN list_min(n[1:2]) END AS low, CASE WHEN {_SPAN} THEN list_max(n[1:2]) END AS high, "
    f"CASE WHEN NOT {_SPAN} THEN n[1] END AS value FROM p WHERE currency IS NOT NULL AND unit IS NOT NULL AND len(n) > 0",
)
def salary_struct(spark, sf_dir):
    rows = A.jobs(spark, sf_dir).select("id", C.salary_struct(F.col("salary_range")).alias("s")).filter("s is not null")
    return rows.select(
        "id", "s.currency", "s.unit", F.col("s.min").cast("double").alias("low"), F.col("s.max").cast("double").alias("high"),
        F.col("s.value").cast("double").alias("value"),
    )


@query(
    "salary_texts",
    A.with_views(A.JOBS_SQL, "s AS (SELECT id, nullif(regexp_extract(job_description, '(?i)(?:salary|compensation|pay)\\s*:?\\s*([^\\n]{0,20}(?:USD|US\\$|\\$|EUR|£)[^\\n]{2,80})', 1), '') AS a, "
                 "nullif(regexp_extract(job_description, '(?i)((?:USD|US\\$|\\$|EUR|£)\\s?[\\d,]+(?:\\s?[–\\-]\\s?(?:USD|US\\$|\\$|EUR|£)?\\s?[\\d,]+)?\\s*(?:per annum|per year|/year|/month|per month|/hour|per hour)?)', 1), '') AS b FROM jobs)")
    + f"SELECT id, substr({D.clean('coalesce(a, b)')}, 1, 120) AS salary FROM s WHERE coalesce(a, b) IS NOT NULL",
)
def salary_texts(spark, sf_dir):
    rows = A.jobs(spark, sf_dir).select("id", C.salary_text(F.col("job_description")).alias("salary"))
    return rows.filter("salary is not null")


@query(
    "deadlines",
    A.with_views(A.JOBS_SQL, f"d AS (SELECT id, regexp_extract(job_description, '(?i)(?:apply by|closing date|deadline|applications? close|application deadline)\\s*:?\\s*([^\\n.;|]{{4,80}})', 1) AS t FROM jobs)")
    + "SELECT id, strftime(try_strptime(t, '%d %B %Y'), '%Y-%m-%d') AS deadline FROM d",
)
def deadlines(spark, sf_dir):
    return A.jobs(spark, sf_dir).select("id", C.deadline(F.col("job_description")).alias("deadline"))


@query(
    "title_cleaning",
    A.with_views(A.JOBS_SQL)
    + f"SELECT id, regexp_replace(title, '\\s*\\|\\s*Apply by.*$', '') AS title, {D.is_role(D.clean('title'))} AS is_role, {D.is_company('company')} AS good_company FROM jobs",
)
def title_cleaning(spark, sf_dir):
    """Titles without deadline tails; role and company tests."""
    c = F.col
    return A.jobs(spark, sf_dir).select(
        "id", T.strip_title(c("title")).alias("title"), C.is_role(T.clean_text(c("title"))).alias("is_role"),
        C.is_company(c("company")).alias("good_company"),
    )


@query(
    "roles_from_text",
    A.with_views(A.JOBS_SQL) + "SELECT id, regexp_extract(job_description, 'Job Title: ([^\\n]+)', 1) AS role FROM jobs",
)
def roles_from_text(spark, sf_dir):
    """Job title found inside the body text."""
    return A.jobs(spark, sf_dir).select("id", C.role_from_text(F.col("job_description")).alias("role"))


@query(
    "companies_from_text",
    A.with_views(A.JOBS_SQL) + "SELECT id, company FROM jobs",
)
def companies_from_text(spark, sf_dir):
    """Company named in headline or body."""
    c = F.col
    return A.jobs(spark, sf_dir).select("id", C.infer_company(c("title"), c("job_description")).alias("company"))


@query("clean_titles")
def clean_titles(spark, sf_dir):
    """Full title rule: split, prefixes, company part, fallback to the body."""
    c = F.col
    title = F.concat_ws(" ", c("company"), F.lit("is hiring:"), c("title"))
    return A.jobs(spark, sf_dir).select("id", C.clean_title(title, c("company"), c("job_description")).alias("title"))


@query("summaries")
def summaries(spark, sf_dir):
    c = F.col
    return A.jobs(spark, sf_dir).select("id", C.make_summary(c("title"), c("job_description")).alias("summary"))


@query("sections")
def sections(spark, sf_dir):
    """Text under a requirements heading up to the next heading."""
    body = F.concat(F.lit("Requirements\n"), F.col("text"), F.lit("\nHow to apply\nSend a letter."))
    return A.texts(spark, sf_dir, "documents").select("doc_id", C.section(body, V.REQUIREMENT_HEADINGS).alias("section"))


def _domain_sql():
    lab = "CASE WHEN len(p) >= 3 AND (p[-2] || '.' || p[-1]) IN (" + ", ".join(D.q(x) for x in V.TWO_LEVEL_SUFFIXES) + ") THEN p[-3] ELSE p[-2] END"
    core = "regexp_replace(label, '^(?:the|my|go|get)[-_]?', '')"
    gen = ", ".join(D.q(x) for x in V.GENERIC_DOMAIN_LABELS)
    pieces = f"list_filter(regexp_split_to_array({core}, '[-_.]+'), lambda x: x <> '' AND x NOT IN ({gen}))"
    split = D.first_of(
        [(f"ends_with(x[1], {D.q(e)}) AND length(x[1]) > {len(e) + 2}", f"[substr(x[1], 1, length(x[1]) - {len(e)}), {D.q(e)}]") for e in V.COMPANY_NAME_ENDINGS], "x"
    )
    name = "array_to_string(list_transform(y, lambda w: CASE WHEN w IN (" + ", ".join(D.q(a) for a in V.DOMAIN_ACRONYMS) + ") THEN upper(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"
    free = ", ".join(D.q(x) for x in V.FREE_MAIL_DOMAINS)
    return A.with_views(
        A.USERS_SQL,
        "m AS (SELECT id, lower(regexp_extract(email, '(?i)[A-Z0-9._%+\\-]+@([A-Z0-9.\\-]+\\.[A-Z]{2,})', 1)) AS domain FROM users)",
        "p AS (SELECT id, domain, string_split(domain, '.') AS p FROM m)",
        f"l AS (SELECT *, {lab} AS label FROM p)",
        f"x AS (SELECT *, {pieces} AS x FROM l)",
        f"y AS (SELECT *, CASE WHEN len(x) = 1 THEN {split} ELSE x END AS y FROM x)",
        f"z AS (SELECT id, CASE WHEN domain NOT IN ({free}) AND label NOT IN ({gen}) THEN {name} END AS company FROM y)",
    ) + f"SELECT id, CASE WHEN {D.is_company('company')} THEN company END AS company FROM z"


@query("email_domains", _domain_sql())
def email_domains(spark, sf_dir):
    """Company named by a mail domain."""
    text = F.concat(F.lit("Send it to "), F.col("email"), F.lit(" today"))
    return A.users(spark, sf_dir).select("id", C.company_from_email(text).alias("company"))


@query(
    "email_domains_of_texts",
    None,
)
def email_domains_of_texts(spark, sf_dir):
    """Company names spelled by mail addresses inside document texts."""
    rows = A.texts(spark, sf_dir, "documents").select("doc_id", C.company_from_email(F.col("text")).alias("company"))
    return rows.filter("company is not null")


def _codes_sql():
    look = D.first_of([(f"k = {D.q(k)}", D.q(v)) for k, v in V.PUBLISHED_EMPLOYMENT_CODES.items()])
    return A.with_views(
        A.JOBS_SQL,
        "e AS (SELECT id, coalesce(employment_type, '') || CASE WHEN id % 3 = 0 THEN ' / Temporary and Contract' ELSE '' END AS t FROM jobs)",
        f"p AS (SELECT id, unnest(regexp_split_to_array(t, '[,;/|+]| and ')) AS k, generate_subscripts(regexp_split_to_array(t, '[,;/|+]| and '), 1) AS i FROM e)",
        f"c AS (SELECT id, i, {look} AS code FROM (SELECT id, i, replace(lower(trim(k)), '_', ' ') AS k FROM p))",
        "f AS (SELECT id, code, min(i) AS i FROM c WHERE code IS NOT NULL GROUP BY ALL)",
    ) + "SELECT id, string_agg(code, ',' ORDER BY i) AS codes FROM f GROUP BY id"


@query("employment_codes", _codes_sql())
def employment_codes(spark, sf_dir):
    extra = F.when(F.col("id") % 3 == 0, F.lit(" / Temporary and Contract")).otherwise(F.lit(""))
    text = F.concat(T.empty_if_null(F.col("employment_type")), extra)
    rows = A.jobs(spark, sf_dir).select("id", F.array_join(C.employment_codes(text), ",").alias("codes"))
    return rows.filter("codes <> ''")


@query(
    "geo",
    A.with_views(A.JOBS_SQL, "g AS (SELECT id, location, trim(regexp_replace(regexp_replace(regexp_replace(location, '(?i)hybrid|on-site|onsite|remote', '', 'g'), '\\s*[/-]\\s*', ' ', 'g'), '\\s+', ' ', 'g'), ' ,-') AS place FROM jobs)")
    + "SELECT id, place, CASE WHEN contains(lower(place), 'zimbabwe') THEN 'ZW' WHEN contains(lower(place), 'south africa') THEN 'ZA' WHEN contains(lower(place), 'harare') OR contains(lower(place), 'bulawayo') THEN 'ZW' "
    "WHEN NOT regexp_matches(lower(place), 'africa') AND place <> '' THEN 'ZW' END AS country, "
    "CASE WHEN place LIKE 'Harare%' THEN 'Harare' ELSE place END AS locality FROM g",
)
def geo(spark, sf_dir):
    place = C.physical_place(F.col("location"))
    return A.jobs(spark, sf_dir).select("id", place.alias("place")).select(
        "id", "place", C.country_code(F.col("place"), "ZW").alias("country"), C.locality(F.col("place")).alias("locality")
    )
