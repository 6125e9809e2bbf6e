"""Extraction and classification columns over listing text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from . import vocab as V
from .text import (
    bind, clean_text, cut_at_word, empty_if_null, first_of_each_key, fold, inline, is_noise_line, normalize_block,
    has, null_if_empty, one_line, one_line_of, strip_tail, words_pattern,
)

ROLE_WORD = "(?i)" + words_pattern(V.ROLE_WORDS)
BULLET = r"^\s*(?:[•\-*]\s*)?"


def _escape(label: str) -> str:
    return label.replace("&", r"\&").replace("-", r"\-")


# ------------------------------------------------------------------ titles, roles
def is_role(c: Column) -> Column:
    """Does the text read like one job title?"""
    not_a_title = "|".join(
        [
            V.GENERIC_TITLE + r"\b", V.TASK_VERB_START + r"\b", r"\b" + V.TITLE_REQUIREMENT_WORDS + r"\b",
            r"\b(?:is|are)\s+hiring\b", r"\bapply\s+by\b", r"\bdeadline\b", r"\bclosing\s+date\b",
        ]
    )
    return bind(
        c,
        lambda t: F.length(t).between(5, 120) & t.rlike(ROLE_WORD) & ~t.rlike("(?i)" + not_a_title),
    )


def is_company(c: Column) -> Column:
    not_a_name = "|".join(
        [
            r"^(?:" + "|".join(V.NOT_A_COMPANY) + ")$", V.BAD_COMPANY_START + r"\b",
            r"\b" + V.BAD_COMPANY_VERB + r"\b", "[.!?]", "^(?:[^ ]* ){8}",
        ]
    )
    return bind(
        c,
        lambda t: F.length(t).between(2, 90) & t.rlike("[A-Za-z0-9]") & ~t.rlike("(?i)" + not_a_name),
    )


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def role_from_text(body: Column) -> Column:
    """Job title inside a text: labelled line, label above its value, then heading line."""
    labels = "|".join(V.ROLE_LABELS)
    priority = F.array(*[F.lit(x.lower()) for x in V.ROLE_LABELS])

    def pick(b):
        labelled_re = F.lit(rf"(?im){BULLET}({labels})\s*:\s*([^\n|•]+)")
        pairs = F.arrays_zip(
            F.regexp_extract_all(b, labelled_re, F.lit(1)).alias("label"),
            F.regexp_extract_all(b, labelled_re, F.lit(2)).alias("value"),
        )
        ranked = F.filter(
            F.transform(
                pairs,
                lambda p, i: F.struct(
                    F.array_position(priority, F.lower(p["label"])).alias("rank"),
                    i.alias("pos"),
                    strip_tail(p["value"]).alias("role"),
                ),
            ),
            lambda r: is_role(r["role"]),
        )
        labelled = F.array_min(ranked)["role"]

        lines = F.transform(
            F.split(b, "\n"), lambda x: one_line_of(x, F.regexp_replace(x, r"^[•\-*]\s*", ""))
        )

        def scan(ls):
            below = F.flatten(
                F.transform(
                    F.filter(
                        F.transform(ls, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                        lambda e: e["x"].rlike(rf"(?i)^(?:{labels})\s*:?$"),
                    ),
                    lambda e: F.transform(F.slice(ls, e["i"] + 2, 3), strip_tail),
                )
            )
            likely = F.filter(ls, lambda x: (F.length(x) <= 130) & x.rlike(ROLE_WORD))

            def candidates(x):
                in_line = [
                    F.when(
                        F.contains(x, F.lit(":")),
                        null_if_empty(strip_tail(F.regexp_extract(x, rf"(?i){lab}\s*:\s*(.+)$", 1))),
                    )
                    for lab in V.ROLE_LABELS
                ]
                bare = F.regexp_replace(x, r"\s+[–—-]\s+[A-Z][A-Za-z0-9 &.'’/-]{2,80}$", "")
                skip = x.rlike(r"(?i)^(?:how to apply|about|contents|the role)$")
                return F.array_compact(F.array(*in_line, F.when(~skip, strip_tail(bare))))

            heading = F.flatten(F.transform(likely, candidates))
            return F.coalesce(_first(F.filter(below, is_role)), _first(F.filter(heading, is_role)))

        return F.coalesce(labelled, bind(lines, scan))

    return bind(
        clean_text(body, keep_lines=True), lambda b: F.when(b.rlike(ROLE_WORD), pick(b))
    )


HIRING_SPLITS = [   # pattern, company group, title group
    (r"^(.+?)\s+(?:is|are)\s+hiring\s*:?\s*(?:(?:for|to fill)\s+)?(?:a|an|the)?\s*(.+)$", 1, 2),
    (r"^(.+?)\s+hiring\s*:?\s*(?:(?:for|to fill)\s+)?(?:a|an|the)?\s*(.+)$", 1, 2),
    (r"^(.+?)\s+(?:seeks|is seeking|are seeking|is recruiting|are recruiting)\s*:?\s*(?:a|an|the)?\s*(.+)$", 1, 2),
    (r"^(.+?)\s+(?:at|with)\s+([A-Z0-9][A-Za-z0-9 &.,'’/-]{2,80})$", 2, 1),
]


def split_hiring_title(title: Column) -> Column:
    """struct(company, role) of an "X is hiring Y" headline, or null."""

    def pick(t):
        tries = []
        for pattern, company_at, role_at in HIRING_SPLITS:
            company = one_line(F.regexp_extract(t, "(?i)" + pattern, company_at))
            role = F.regexp_replace(
                one_line(F.regexp_extract(t, "(?i)" + pattern, role_at)),
                r"(?i)^(?:for\s+)?(?:the\s+)?(?:position|role|post)\s+of\s+", "",
            )
            tries.append(F.struct(company.alias("company"), strip_tail(role).alias("role")))
        return _first(
            F.filter(F.array(*tries), lambda s: is_company(s["company"]) & is_role(s["role"]))
        )

    hint = r"(?i)\s(?:hiring|seeks|seeking|recruiting|at|with)\b"
    return bind(strip_tail(title), lambda t: F.when(t.rlike(hint), pick(t)))


def clean_title(title: Column, company: Column | None, text: Column | None, max_chars: int = 80) -> Column:
    """Role title only: company, deadline, salary and workplace parts removed."""
    prefix = r"(?i)^(job title|position title|position|role title|role|vacancy|post)\s*:\s*"
    paid = r"(?i)\b(?:hiring|recruiting|paying|earn|salary|compensation|usd|eur|gbp)\b"

    def without_owner(t, owner):
        rest = F.substr(t, F.length(owner) + 1)
        led = F.startswith(F.lower(t), F.lower(owner)) & rest.rlike(r"^\s*[-–—:|]")
        return F.when(led, strip_tail(F.regexp_replace(rest, r"^\s*[-–—:|]\s*", ""))).otherwise(t)

    def own_title(original, split):
        t = strip_tail(F.regexp_replace(F.coalesce(split["role"], strip_tail(original)), prefix, ""))
        named = [] if company is None else [null_if_empty(clean_text(company))]
        owner = F.coalesce(*named, split["company"], F.lit(""))
        t = bind(t, lambda x: bind(owner, lambda o: F.when(o != "", without_owner(x, o)).otherwise(x)))
        return F.regexp_replace(t, r"(?i)\s+vacanc(?:y|ies)\s*(?:20\d{2})?\b.*$", "")

    def choose(original, found):
        t = bind(split_hiring_title(original), lambda s: own_title(original, s))
        t = bind(
            t,
            lambda x: F.when(found.isNotNull() & (~is_role(x) | original.rlike(paid)), found).otherwise(x),
        )
        t = one_line(cut_at_word(t, max_chars))
        t = F.coalesce(null_if_empty(t), F.substring(original, 1, max_chars))
        return F.when(original == "", F.coalesce(found, F.lit("Untitled role"))).otherwise(t)

    found = F.lit(None).cast("string") if text is None else role_from_text(text)
    return bind(clean_text(title), lambda o: bind(found, lambda f: choose(o, f)))


# ------------------------------------------------------------------ companies
def _first_company(candidates: Column, tidy) -> Column:
    return _first(F.filter(F.transform(candidates, tidy), lambda x: is_company(x)))


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def company_from_text(title: Column, text: Column) -> Column:
    """Company named in a headline or body, by ordered patterns."""
    heading = clean_text(title)
    body = clean_text(text, keep_lines=True)
    jobs_line = (
        r"(?i)^([A-Z0-9][A-Za-z0-9 &.'’/-]{2,90}?)\s+(?:Zimbabwe\s+)?Jobs?\s+"
        r"(?:[A-Za-z]+\s+20\d{2}|20\d{2})\s+[–—-]\s+"
        r"(?:Multiple\s+Vacanc(?:y|ies)|\d+\s+(?:new\s+)?job\s+positions?)"
    )

    def drop_jobs(x):
        return F.regexp_replace(one_line(x), r"(?i)\s+(?:Zimbabwe\s+)?Jobs?$", "")

    def pick(b):
        head_lines = F.concat(F.array(heading), F.slice(F.split(b, "\n"), 1, 8))
        from_jobs_line = _first_company(
            F.transform(
                F.filter(head_lines, lambda x: F.contains(F.lower(x), F.lit("job"))),
                lambda x: F.regexp_extract(one_line_of(x, x), jobs_line, 1),
            ),
            one_line,
        )
        rules = [
            r"(?im)^\s*(?:Company|Organisation|Organization|Employer)\s*:\s*([^\n]{2,90})",
            r"(?im)^\s*About\s+([A-Z0-9][A-Za-z0-9 &.'’/-]{2,90}?)(?:\s+The\s+(?:organisation|organization|company)\b|\n|$)",
            r"(?im)^\s*([A-Z0-9][A-Za-z0-9 &.'’/-]{2,90}?)\s+is\s+(?:inviting|seeking|looking|hiring|recruiting)\b",
            r"(?im)^\s*([A-Z0-9][A-Za-z0-9 &.'’/-]{2,90}?)\s*,\s+(?:operating|based|a\s+registered|an?\s+international)",
        ]
        split = bind(
            split_hiring_title(heading)["company"], lambda x: F.when(is_company(x), x)
        )
        return F.coalesce(
            from_jobs_line, split, *[_first_company(_matches(b, p), drop_jobs) for p in rules]
        )

    return bind(body, pick)


def infer_company(title: Column, text: Column) -> Column:
    joined = F.concat_ws("\n", title, text)
    rules = [
        r"(?im)^\s*(?:job|vacancy|opening)\s+at\s+([^\|\n\-–—:]{2,80})",
        r"(?im)^\s*(?:Company|Organisation|Organization|Employer)\s*:\s*([^\n]{2,80})",
        r"(?im)^\s*About\s+([A-Z0-9][A-Za-z0-9 &.,'’/-]{2,80}?)(?:\s+The\s+(?:organisation|organization|company)\b|\n|$)",
    ]

    def tidy(x):
        x = F.regexp_replace(one_line(x), r"(?i)\s+(?:job|vacancy|role|position)$", "")
        return F.trim(F.regexp_replace(x, r"\s*\|.*$", ""))

    tries = []
    for p in rules:
        found = tidy(F.regexp_extract(joined, p, 1))
        tries.append(bind(found, lambda x: F.when(is_company(x), x)))
    return F.coalesce(company_from_text(title, text), *tries, F.lit("Confidential"))


def _tidy_named_company(x: Column) -> Column:
    cuts = [
        r"^(?:the\s+company|company|organisation|organization|employer|hiring\s+company)\s*:?\s*",
        r"\s+(?:Zimbabwe\s+)?Jobs?$",
        r"\s*\|.*$",
        r"\s+[-–—]\s+(?:job|vacanc(?:y|ies)|role|position).*$",
        r"\s+(?:is|are)\s+(?:hiring|recruiting|seeking|looking|inviting|a|an|the)\b.*$",
        r"\s+\b(?:job|vacancy|role|position)$",
    ]
    reject = (
        r"(?i)\b(?:applicants?|candidates?|applications?|qualifications?|requirements?|duties|responsibilities)\b"
    )

    def tidy(t):
        pronoun = F.lower(t).isin("we", "us", "our", "ours", "they", "them", "their", "the company")
        for c in cuts:
            t = F.regexp_replace(t, "(?i)" + c, "")
        return F.when(~pronoun, one_line(F.btrim(t, F.lit(" ,;:"))))

    return bind(bind(one_line(x), tidy), lambda t: F.when(~t.rlike(reject), t))


def _named(candidates: Column, reject: str | None = None) -> Column:
    ok = F.filter(F.transform(candidates, _tidy_named_company), is_company)
    if reject:
        ok = F.filter(ok, lambda x: ~x.rlike(reject))
    return _first(ok)


def explicit_company(title: Column, text: Column) -> Column:
    rules = [
        r"(?im)^\s*(?:[•\-*]\s*)?(?:Company|Organisation|Organization|Employer|Hiring\s+Company|Hiring\s+Organization|The\s+company)\s*:\s*([^\n]{2,120})",
        r"(?im)^\s*About\s+([^\n:]{2,120}?)(?:\s+(?:is|are|the\s+(?:organisation|organization|company))\b|\n|$)",
        r"(?im)^\s*([^\n]{2,120}?)\s+(?:is|are)\s+(?:an?\s+(?:international|registered|non[- ]governmental|ngo|company|organisation|organization)|the\s+(?:company|organisation|organization))\b",
        r"(?im)^\s*([^\n]{2,120}?)\s+(?:is|are)\s+(?:hiring|recruiting|seeking|looking\s+for|inviting)\b",
        r"(?im)\bApplications\s+are\s+invited\s+from\s+suitably\s+qualified\s+candidates\s+by\s+([^\n.;]{2,120})",
    ]
    return bind(
        clean_text(text, keep_lines=True),
        lambda b: F.coalesce(
            *[_named(_matches(b, p)) for p in rules], _named(F.array(company_from_text(title, b)))
        ),
    )


def known_organisation(text: Column) -> Column:
    ending = (
        r"(?<![\w-])((?:The\s+)?[A-Z][\wÀ-ÖØ-öø-ÿ&.'’/-]*(?:\s+[A-Z][\wÀ-ÖØ-öø-ÿ&.'’/-]*){0,7}\s+"
        rf"(?:{V.ORGANISATION_ENDINGS}))\b"
    )
    reject = r"(?i)\b(?:Job|Vacancy|Application|Selection|Human Resources|Finance Department)\b"

    def pick(b):
        named = [F.when(b.rlike(rf"(?i)(?<![\w-]){n}(?![\w-])"), F.lit(n)) for n in V.KNOWN_ORGANISATIONS]
        return F.coalesce(*named, _named(_matches(b, ending), reject))

    return bind(text, pick)


def mail_domains(c: Column) -> Column:
    found = F.regexp_extract_all(
        c, F.lit(r"(?i)\b[A-Z0-9._%+\-]+@([A-Z0-9.\-]+\.[A-Z]{2,})\b"), F.lit(1)
    )
    return F.transform(found, lambda d: F.btrim(F.lower(d), F.lit(".")))


def company_of_domain(domain: Column) -> Column:
    """Company name spelled by a mail domain, or null for free mail and generic labels."""
    generic = F.array(*[F.lit(x) for x in V.GENERIC_DOMAIN_LABELS])

    def label_of(parts):
        n = F.size(parts)
        tail = F.concat_ws(".", F.get(parts, n - 2), F.get(parts, n - 1))
        return F.when(tail.isin(V.TWO_LEVEL_SUFFIXES) & (n >= 3), F.get(parts, n - 3)).otherwise(
            F.get(parts, n - 2)
        )

    def split_ending(pieces):
        one = F.get(pieces, F.lit(0))
        split = first_of(
            [
                (
                    F.endswith(one, F.lit(e)) & (F.length(one) > len(e) + 2),
                    F.array(F.substr(one, F.lit(1), F.length(one) - len(e)), F.lit(e)),
                )
                for e in V.COMPANY_NAME_ENDINGS
            ]
        )
        return F.when(F.size(pieces) == 1, F.coalesce(split, pieces)).otherwise(pieces)

    def spell(pieces):
        words = F.transform(
            pieces,
            lambda p: F.when(p.isin(V.DOMAIN_ACRONYMS), F.upper(p)).otherwise(
                F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
            ),
        )
        return F.array_join(words, " ")

    def name_of(label):
        core = F.split(F.regexp_replace(label, r"^(?:the|my|go|get)[-_]?", ""), "[-_.]+")
        pieces = F.filter(core, lambda p: (p != "") & ~F.array_contains(generic, p))
        name = spell(bind(pieces, split_ending))
        return F.when(
            ~F.array_contains(generic, label), bind(name, lambda x: F.when(is_company(x), x))
        )

    parts = F.filter(F.split(domain, r"\."), lambda p: p != "")
    return F.when(~domain.isin(V.FREE_MAIL_DOMAINS), bind(bind(parts, label_of), name_of))


def company_from_email(c: Column) -> Column:
    names = F.transform(mail_domains(one_line(c)), company_of_domain)
    return F.when(F.contains(c, F.lit("@")), _first(F.array_compact(names)))


def is_aggregator_name(company: Column) -> Column:
    return F.regexp_replace(F.lower(clean_text(company)), "[^a-z0-9]+", "") == V.AGGREGATOR_ALIAS


def in_aggregator_context(location: Column, source_name: Column, source_url: Column) -> Column:
    source = F.lower(F.concat_ws(" ", empty_if_null(source_name), empty_if_null(source_url)))
    return (
        F.lower(clean_text(location)).rlike(r"\bzimbabwe\b")
        | F.contains(source, F.lit(V.AGGREGATOR_SOURCE))
        | F.endswith(U.host(empty_if_null(source_url)), F.lit(V.AGGREGATOR_HOST))
    )


def repair_company(company, title, text, location, source_name, source_url, apply_url) -> Column:
    """Hiring company of a row that only names the aggregator, or null."""
    parts = [null_if_empty(clean_text(c, keep_lines=True)) for c in (text, apply_url, source_url)]
    found = bind(
        F.concat_ws("\n", *parts),
        lambda b: F.coalesce(explicit_company(title, b), known_organisation(b), company_from_email(b)),
    )
    eligible = is_aggregator_name(company) & in_aggregator_context(location, source_name, source_url)
    return F.when(eligible, bind(found, lambda x: F.when(~is_aggregator_name(x), x)))


# ------------------------------------------------------------------ labelled values
def labelled(
    c: Column, labels, max_chars: int = 160, below: bool = False, colon: str = ":?"
) -> Column:
    """Value of the first label, in label order, whose first line has a short enough value."""

    def value(b, label):
        found = F.regexp_extract(b, rf"(?im){BULLET}{_escape(label)}\s*{colon}\s*([^\n]+)", 1)
        most = max_chars - 1 if below else max_chars
        return bind(one_line(found), lambda v: F.when(F.length(v).between(1, most), v))

    return bind(clean_text(c, keep_lines=True), lambda b: F.coalesce(*[value(b, x) for x in labels]))


def section(c: Column, headings, max_chars: int = 1600) -> Column:
    """Body under a heading up to the next known heading."""
    alt = "|".join(_escape(h) for h in headings)
    pattern = rf"(?ims)^\s*(?:{alt})\s*:?\s*(.+?)(?=^\s*(?:{V.NEXT_SECTION})\s*:?\s*$|\z)"

    def body(b):
        lines = F.filter(
            F.transform(F.split(clean_text(F.regexp_extract(b, pattern, 1), keep_lines=True), "\n"), lambda x: one_line_of(x, x)),
            lambda x: x != "",
        )

        def until_heading(ls):
            stops = F.transform(ls, lambda x: x.rlike("(?i)" + V.SECTION_HEADING_LINE))
            at = F.array_position(stops, F.lit(True)).cast("int")
            return F.array_join(F.when(at > 0, F.slice(ls, F.lit(1), at - 1)).otherwise(ls), "\n")

        return null_if_empty(cut_at_word(bind(lines, until_heading), max_chars, ".,; "))

    return bind(clean_text(c, keep_lines=True), body)


def repeated_labels(body: Column, labels) -> Column:
    """Labels that carry more than one distinct value in one (already cleaned) text."""
    out = []
    for label in labels:
        values = F.regexp_extract_all(
            body, F.lit(rf"(?im){BULLET}{_escape(label)}\s*:?\s*([^\n]{{2,140}})"), F.lit(1)
        )
        keys = F.filter(F.array_distinct(F.transform(values, fold)), lambda k: k != "")
        out.append(F.when(F.size(keys) > 1, F.lit(label)))
    return F.array_compact(F.array(*out))


# ------------------------------------------------------------------ classes
def first_of(cases, default=None) -> Column:
    """Value of the first true condition."""
    col = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        col = F.when(cond, value) if col is None else col.when(cond, value)
    return col if default is None else col.otherwise(default)


def term_pattern(terms) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(terms) + ")(?![a-z0-9])"


def employment_type(c: Column) -> Column:
    low = F.lower(c)
    return first_of([(F.contains(low, F.lit(t)) & low.rlike(rf"\b{t}\b"), v) for t, v in V.EMPLOYMENT_TERMS])


def remote_status(location: Column, text: Column) -> Column:
    low = F.lower(F.concat_ws(" ", location, text))
    return first_of(
        [(F.contains(low, F.lit(t)), v) for t, v in V.WORKPLACE_TERMS], F.lit("On-site")
    )


def location(value: Column, title: Column, text: Column, default: Column) -> Column:
    joined = F.concat_ws(
        " ", empty_if_null(value), empty_if_null(title), F.substring(empty_if_null(text), 1, 900)
    )

    def pick(c):
        remote = c.rlike("(?i)" + V.REMOTE_HINT)
        hybrid = c.rlike("(?i)hybrid")
        place = [(c.rlike(rf"(?i)\b{p}\b"), p) for p in V.NAMED_PLACES]
        return first_of(
            [
                (remote & c.rlike("(?i)" + V.REMOTE_COUNTRY_HINT), "Remote / Zimbabwe"),
                (remote & c.rlike("(?i)" + V.REMOTE_REGION_HINT), "Remote / Africa"),
                (remote, "Remote"),
                *[(hybrid & c.rlike(rf"(?i)\b{p}\b"), f"Hybrid / {p}") for p in V.HYBRID_PLACES],
                (hybrid, "Hybrid"),
                *place,
            ],
            F.coalesce(null_if_empty(one_line(value)), default),
        )

    return bind(clean_text(joined), pick)


def _category_name(c: Column) -> Column:
    """Current name of a category: renamed when old, itself when current, else empty."""
    t = one_line(c)
    old = first_of([(F.lower(t) == k, v) for k, v in V.OLD_CATEGORY_NAMES.items()])
    return F.coalesce(old, F.when(t.isin(V.INFERRED_CATEGORIES), t), F.lit(""))


def infer_category(title: Column, text: Column, default: Column) -> Column:
    low = F.lower(F.concat_ws(" ", title, text))
    fallback = F.coalesce(null_if_empty(_category_name(default)), F.lit("Private Sector"))
    return bind(
        low,
        lambda c: first_of([(c.rlike(term_pattern(t)), k) for k, t in V.CATEGORY_TERMS.items()], fallback),
    )


def category(raw: Column, title: Column, loc: Column, text: Column, default: Column) -> Column:
    def pick(found):
        strong = found.isin("Remote & International", "Internships")
        return F.when(strong, found).otherwise(
            F.coalesce(null_if_empty(_category_name(raw)), found)
        )

    return bind(infer_category(title, F.concat_ws("\n", loc, text), default), pick)


# ------------------------------------------------------------------ money
def salary_text(c: Column) -> Column:
    money = r"(?:USD|US\$|\$|EUR|£)"
    tries = [
        rf"(?i)(?:salary|compensation|pay)\s*:?\s*([^\n]{{0,20}}{money}[^\n]{{2,80}})",
        rf"(?i)({money}\s?[\d,]+(?:\s?[–\-]\s?{money}?\s?[\d,]+)?\s*"
        r"(?:per annum|per year|/year|/month|per month|/hour|per hour)?)",
    ]
    found = bind(c, lambda t: F.coalesce(*[null_if_empty(F.regexp_extract(t, p, 1)) for p in tries]))
    return null_if_empty(F.substring(one_line(found), 1, 120))


def salary_struct(c: Column) -> Column:
    """struct(currency, unit, min, max, value) of a salary text, or null when incomplete."""
    return bind(inline(c), _salary_of)


def _salary_of(t: Column) -> Column:
    low = F.lower(t)
    currency = first_of(
        [
            (t.rlike(r"(?i)\b(?:USD\b|US\$|US\s+dollars?\b)"), "USD"),
            (t.rlike(r"(?i)\bEUR\b|€"), "EUR"),
            (t.rlike(r"(?i)\bGBP\b|£"), "GBP"),
            (t.rlike(r"(?i)\bZAR\b"), "ZAR"),
        ]
    )
    unit = first_of(
        [
            (low.rlike(r"/\s*hour|per\s+hour|hourly"), "HOUR"),
            (low.rlike(r"/\s*day|per\s+day|daily"), "DAY"),
            (low.rlike(r"/\s*week|per\s+week|weekly"), "WEEK"),
            (low.rlike(r"/\s*month|per\s+month|monthly"), "MONTH"),
            (low.rlike(r"/\s*year|per\s+year|annually|annual|per\s+annum"), "YEAR"),
        ]
    )
    numbers = F.transform(
        F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d+(?:,\d{3})*(?:\.\d+)?)(?!\d)"), F.lit(1)),
        lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(18,2)"),
    )

    def build(ns):
        spans = (F.size(ns) >= 2) & t.rlike(r"(?i)\b(?:to|through)\b|[-–—]")
        pair = F.slice(ns, 1, 2)
        ok = currency.isNotNull() & unit.isNotNull() & (F.size(ns) > 0)
        return F.when(
            ok,
            F.struct(
                currency.alias("currency"),
                unit.alias("unit"),
                F.when(spans, F.array_min(pair)).alias("min"),
                F.when(spans, F.array_max(pair)).alias("max"),
                F.when(~spans, F.get(ns, F.lit(0))).alias("value"),
            ),
        )

    return bind(numbers, build)


# ------------------------------------------------------------------ dates
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)


def _date_of(day: Column, month: Column, year: Column) -> Column:
    text = F.concat_ws(" ", day, F.initcap(F.substring(month, 1, 3)), year)
    return F.when(F.length(day) > 0, F.try_to_date(text, "d MMM yyyy"))


def _partial_date(t: Column, as_of: Column) -> Column:
    """Date of a text that names parts of one: month words, day numbers, a year, or a weekday alone.

    Parts not named come from ``as_of``, the day cut to the month's length; a weekday alone is the next one from there on.
    """
    text = F.regexp_replace(t, r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]m\b)?|\b\d{1,2}\s*[ap]m\b", " ")
    part = lambda pattern, n=1: null_if_empty(F.regexp_extract(text, pattern, n))
    nth = "(?:st|nd|rd|th)?"
    month_word = part(rf"(?i)\b({MONTH})\b")
    number = lambda x: x.cast("int")
    slash = r"(?<!\d)(\d{1,2})/(\d{1,2})(?![\d/])"
    month = F.coalesce(
        F.month(F.try_to_date(F.concat(F.lit("1 "), F.initcap(F.substring(month_word, 1, 3)), F.lit(" 2000")), "d MMM yyyy")),
        number(part(slash)),
    )
    day = F.coalesce(
        part(rf"(?i)(?<!\d)(\d{{1,2}}){nth}[ \-]+(?:of +)?{MONTH}\b"), part(rf"(?i)\b{MONTH}\.?[ \-]+(\d{{1,2}}){nth}(?!\d)"), part(slash, 2),
        F.when(month_word.isNull(), part(rf"(?i)(?<![\d/.\-])(\d{{1,2}}){nth}(?![\d/.\-])")),
    )
    # two digits after day and month mean the year nearest to as_of's century
    short = number(part(rf"(?i)\d{{1,2}}{nth}[ \-]+(?:of +)?{MONTH}\.?,?[ \-]+'?(\d{{2}})(?!\d)"))
    near = short + F.year(as_of) - F.year(as_of) % 100
    near = F.when(near >= F.year(as_of) + 50, near - 100).when(near < F.year(as_of) - 50, near + 100).otherwise(near)
    year = F.coalesce(number(part(r"(?<!\d)(\d{4})(?!\d)")), near)
    y, m = F.coalesce(year, F.year(as_of)), F.coalesce(month, F.month(as_of))
    joined = lambda d: F.concat_ws("-", y.cast("string"), m.cast("string"), d)
    last = F.day(F.last_day(F.try_to_date(joined(F.lit("1")), "y-M-d")))
    d = F.coalesce(day, F.least(F.day(as_of), last).cast("string"))
    weekday = part(r"(?i)\b(mon|tue|wed|thu|fri|sat|sun)(?:day|s|sday|nesday|rs|rsday|urday)?\b")
    named = F.coalesce(year, month).isNotNull() | day.isNotNull()
    return F.when(named, F.try_to_date(joined(d), "y-M-d")).otherwise(F.call_function("next_day", F.date_sub(as_of, 1), weekday))


def parse_date(c: Column, as_of: Column | None = None) -> Column:
    """ISO date of a date-like text; rolling or unreadable deadlines give null.

    With ``as_of`` a text that names only parts of a date is read too (``_partial_date``).
    """
    t = F.regexp_replace(
        one_line(c),
        r"(?i)^(last updated|posted|date|closing date|deadline|apply by|applications? close)\s*:?\s*",
        "",
    )
    t = F.replace(t, F.lit("at "), F.lit(""))
    open_ended = "(?i)rolling|ongoing|asap|until filled"
    read = _read_date if as_of is None else lambda x: F.coalesce(_read_date(x), _partial_date(x, as_of))
    return bind(t, lambda x: F.when((x != "") & ~x.rlike(open_ended), F.date_format(read(x), "yyyy-MM-dd")))


def _read_date(t: Column) -> Column:
    iso = F.regexp_extract(t, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    dmy = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[ \-]+(?:of +)?({MONTH})\.?,?[ \-]+(\d{{4}})"
    mdy = rf"(?i)\b({MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
    slash = F.regexp_extract(t, r"(?<!\d)(\d{1,2}/\d{1,2}/\d{4})(?!\d)", 1)
    ymd = F.regexp_extract(t, r"(?<!\d)(\d{4}/\d{1,2}/\d{1,2})(?!\d)", 1)
    found = lambda pattern, n: F.regexp_extract(t, pattern, n)
    return F.coalesce(
        F.try_to_date(null_if_empty(iso), "yyyy-M-d"),
        F.try_to_date(null_if_empty(ymd), "yyyy/M/d"),
        _date_of(found(dmy, 1), found(dmy, 2), found(dmy, 3)),
        _date_of(found(mdy, 2), found(mdy, 1), found(mdy, 3)),
        F.try_to_date(null_if_empty(slash), "M/d/yyyy"),
        F.try_to_date(null_if_empty(slash), "d/M/yyyy"),
    )


DEADLINE_PATTERNS = [
    r"(?i)(?:apply by|closing date|deadline|applications? close|application deadline)\s*:?\s*([^\n.;|]{4,80})",
    r"(?i)by\s+(\d{1,2}\s+[A-Za-z]+\s+20\d{2})",
    r"(?i)(\d{1,2}\s+[A-Za-z]+\s+20\d{2})",
    r"(?i)([A-Za-z]+\s+\d{1,2},\s*20\d{2})",
]


def deadline(c: Column, as_of: Column | None = None) -> Column:
    return bind(
        c, lambda t: F.coalesce(*[parse_date(F.regexp_extract(t, p, 1), as_of) for p in DEADLINE_PATTERNS])
    )


def iso_date(c: Column) -> Column:
    """First ISO date inside a text, as a date."""
    found = F.regexp_extract(empty_if_null(c), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_date(null_if_empty(found), "yyyy-MM-dd")


def age_label(ts: Column, as_of: Column) -> Column:
    s = F.unix_seconds(as_of) - F.unix_seconds(ts)
    days = F.floor(s / 86400)
    return (
        F.when(s < 3600, F.concat(F.greatest(F.floor(s / 60), F.lit(1)).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def deadline_label(c: Column, as_of_date: Column) -> Column:
    d = iso_date(c)
    days = F.datediff(d, as_of_date)
    dated = (
        F.when(days < 0, F.lit("Closed"))
        .when(days == 0, F.lit("Closes today"))
        .when(days == 1, F.lit("Closes tomorrow"))
        .when(days <= 7, F.concat(F.lit("Closes in "), days.cast("string"), F.lit(" days")))
        .otherwise(F.date_format(d, "dd MMM yyyy"))
    )
    raw = F.substring(F.trim(empty_if_null(c)), 1, 40)
    return F.when(d.isNull(), raw).otherwise(dated)


def is_new(ts: Column, as_of: Column, days: int = 3) -> Column:
    return F.coalesce((F.unix_seconds(as_of) - F.unix_seconds(ts)) < days * 86400, F.lit(False))


# ------------------------------------------------------------------ places, codes, devices
def employment_codes(c: Column) -> Column:
    """Published employment codes of a free-text type, distinct, in order."""
    lookup = F.create_map(*[F.lit(x) for kv in V.PUBLISHED_EMPLOYMENT_CODES.items() for x in kv])
    parts = F.transform(
        F.split(inline(c), r"(?i)[,;/|+]|\band\b"),
        lambda p: F.try_element_at(lookup, F.replace(F.lower(F.trim(p)), F.lit("_"), F.lit(" "))),
    )
    return F.array_distinct(F.array_compact(parts))


def physical_place(c: Column) -> Column:
    t = F.regexp_replace(inline(c), r"(?i)\b(?:hybrid|on-site|onsite)\b", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\bremote\b", ""), r"\s*[/-]\s*", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ,-"))


def country_code(place: Column, default: str | None = None) -> Column:
    low = F.lower(place)
    cases = [(low.rlike(rf"\b{k}\b"), code) for k, _, code in V.COUNTRIES]
    cases.append((low.rlike("|".join(V.HOME_CITIES)), "ZW"))
    found = first_of(cases)
    if not default:
        return found
    vague = low.rlike(r"\b(worldwide|global|anywhere|africa|emea)\b")
    return F.coalesce(found, F.when(~vague & (place != ""), F.lit(default)))


def locality(place: Column) -> Column:
    skip = [k for k, _, _ in V.COUNTRIES] + V.NOT_A_LOCALITY
    pieces = F.filter(
        F.transform(F.split(place, "[,/|-]"), lambda p: F.trim(p)),
        lambda p: (p != "") & ~F.lower(p).isin(skip),
    )
    return F.coalesce(F.get(pieces, F.lit(0)), null_if_empty(place))


def applicant_area(loc: Column, default: str | None = None) -> Column:
    """struct(type, name) of where remote applicants may live."""
    low = F.lower(inline(loc))

    def area(kind, name):
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"))

    cases = [
        (low.rlike("zimbabwe|" + "|".join(V.HOME_CITIES)), area("Country", "Zimbabwe")),
        (F.contains(low, F.lit("africa")), area("AdministrativeArea", "Africa")),
        (F.contains(low, F.lit("emea")), area("AdministrativeArea", "EMEA")),
        *[(low.rlike(rf"\b{k}\b"), area("Country", name)) for k, name, _ in V.COUNTRIES],
    ]
    return first_of(cases, area("Country", default) if default else None)


def is_fully_remote(status: Column, loc: Column) -> Column:
    s, low = F.lower(inline(status)), F.lower(inline(loc))
    hybrid = (s == "hybrid") | F.contains(low, F.lit("hybrid"))
    return ~hybrid & ((s == "remote") | low.rlike(r"\b(remote|work from home|home[- ]based)\b"))


def device(user_agent: Column) -> Column:
    ua = F.lower(empty_if_null(user_agent))
    return (
        F.when(ua.rlike("mobile|android|iphone"), F.lit("mobile"))
        .when(ua.rlike("ipad|tablet"), F.lit("tablet"))
        .otherwise(F.lit("desktop"))
    )


# ------------------------------------------------------------------ summary
def _is_heading(line: Column) -> Column:

    def test(bare):
        words = F.filter(F.split(bare, " "), lambda w: w != "")
        capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        n = F.size(words)
        short_title = (
            (F.length(bare) <= 72)
            & ~bare.rlike("[:.!?]")
            & bare.rlike("[A-Za-z]")
            & n.between(2, 8)
            & (capital >= F.greatest(F.lit(1), n - 2))
        )
        return (bare == "") | bare.rlike("(?i)" + V.SECTION_HEADING_LINE) | short_title

    return bind(one_line_of(line, F.regexp_replace(line, r"^[•\-*]\s*", "")), test)


def make_summary(title: Column, text: Column, max_chars: int = 700, own_names: str = "applynow") -> Column:
    """Short summary: descriptive sentences, then labelled facts, then long bullets."""
    chrome = r"(?i)^(?:share on|copy link|save job|apply on official site|always apply on the official source)"
    site = rf"(?i){own_names}|privacy policy|terms of use|cookie"

    def useful(lines, titles):
        # heading-like lines go inside and outside a table of contents alike
        return F.filter(
            lines,
            lambda x: ~is_noise_line(x)
            & ~F.array_contains(titles, F.lower(x))
            & (F.lower(x) != "contents")
            & ~_is_heading(x)
            & ~x.rlike(chrome)
            & ~x.rlike(r"(?i)^(?:source|official source)\s*:")
            & ~((F.length(x) < 120) & x.rlike(site)),
        )

    def choose(ls):
        told = F.filter(ls, lambda x: (F.length(x) >= 70) & ~x.rlike(r"^[A-Za-z /]+\s*:"))
        facts = F.filter(ls, lambda x: x.rlike(rf"(?i)^(?:{V.SUMMARY_FACT_LABELS})\s*:"))
        bullets = F.filter(ls, lambda x: F.startswith(x, F.lit("•")) & (F.length(x) >= 45))
        chosen = F.array_distinct(
            F.concat(F.slice(told, 1, 3), F.slice(facts, 1, 6), F.slice(bullets, 1, 4))
        )
        picked = bind(chosen, lambda c: F.when(F.size(c) > 0, c).otherwise(F.slice(ls, 1, 8)))
        return F.when(F.size(ls) > 0, F.array_join(picked, "\n"))

    def cut(body):
        return F.when(F.length(body) <= max_chars, body).otherwise(
            F.concat(cut_at_word(body, max_chars, ".,; "), F.lit("…"))
        )

    def summarise(block, short_title):
        t = block
        for p in V.SUMMARY_BOILERPLATE:
            t = F.regexp_replace(t, "(?is)" + p, "")
        t = F.when(has(F.lower(block), *V.SUMMARY_BOILERPLATE_STARTS), t).otherwise(block)
        lines = F.transform(
            F.filter(F.transform(F.split(t, "\n"), lambda x: one_line_of(x, x)), lambda x: x != ""),
            lambda x: F.regexp_replace(x, r"(?i)^Selection Process\s+(Job Title\s*:)", "$1"),
        )
        # bound, or it would be made anew for every line
        titles = F.array(F.lower(clean_text(title)), F.lower(short_title))
        kept = first_of_each_key(bind(titles, lambda ts: useful(lines, ts)), fold, keep_unkeyed=False)
        made = bind(normalize_block(bind(kept, choose)), cut)
        return F.when(block == "", title).otherwise(F.coalesce(null_if_empty(made), short_title))

    return bind(
        normalize_block(text),
        lambda b: bind(clean_title(title, None, None), lambda t: summarise(b, t)),
    )
