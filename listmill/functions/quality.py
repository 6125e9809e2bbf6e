"""Predicates and validation rules on listing rows."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .classify import _escape, is_company, is_role, iso_date, repeated_labels
from .text import EDGE, WS, bind, clean_text, empty_if_null, fold, inline, is_noise_line, normalize_block
from .urls import bad_url, is_web_url, path, safe_url


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


# ---- open or closed --------------------------------------------------------------
def closed(tags: Column, expires_at: Column, as_of_date: Column) -> Column:
    """Closed by tag or date, three-valued: an unreadable date gives null, not false."""
    marked = F.contains(
        F.concat(F.lit(","), F.translate(F.lower(empty_if_null(tags)), ";|", ",,"), F.lit(",")),
        F.lit(",closed,"),
    )
    day = F.try_to_date(F.substring(expires_at, 1, 10), "yyyy-MM-dd")
    filled = expires_at.isNotNull() & (F.trim(expires_at) != "")
    return marked | (filled & (day < as_of_date))


# a whole ISO date or time; the validator takes anything else as not expired
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def expired(expires_at: Column, as_of_date: Column) -> Column:
    day = F.try_to_date(F.substring(expires_at, 1, 10), "yyyy-MM-dd")
    return F.coalesce((F.trim(empty_if_null(expires_at)) != "") & (day < as_of_date), F.lit(False))


def closed_strict(tags: Column, expires_at: Column, as_of_date: Column) -> Column:
    """Closed by tag or date, two-valued: tags are trimmed, an unreadable date is open."""
    parts = F.transform(F.split(F.lower(empty_if_null(tags)), "[,;|]"), lambda t: F.trim(t))
    late = F.coalesce(iso_date(expires_at) < as_of_date, F.lit(False))
    return F.array_contains(parts, F.lit("closed")) | late


# ---- unsafe content ----------------------------------------------------------------
def bad_content(text_cols, url_cols) -> Column:
    """Known scraped boilerplate or unsafe addresses anywhere in the row."""
    joined = F.concat_ws("\n", *[empty_if_null(c) for c in [*text_cols, *url_cols]])

    def test(t):
        return bind(
            F.lower(t),
            lambda low: F.contains(t, F.lit(V.BAD_MARKER))
            | any_of([F.contains(low, F.lit(p)) for p in V.BAD_PHRASES])
            | low.rlike(V.BAD_MARKER_PATTERN),
        )

    return bind(joined, test) | any_of([bad_url(c) for c in [*text_cols, *url_cols]])


def stored_bad_content(summary, description, requirements, apply_url, source_url) -> Column:
    """Delete predicate on stored rows: text columns for phrases, URL columns for prefixes."""
    text = F.concat_ws("\n", *[empty_if_null(c) for c in (summary, description, requirements)])
    low = F.lower(text)
    prefixed = [
        F.startswith(F.lower(empty_if_null(u)), F.lit(p))
        for u in (apply_url, source_url)
        for p in V.BAD_URL_PREFIXES
    ]
    return any_of(
        [F.contains(text, F.lit(V.BAD_MARKER))]
        + [F.contains(low, F.lit(p)) for p in V.BAD_PHRASES]
        + prefixed
    )


def bad_reason(haystack: Column) -> Column:
    low = F.lower(haystack)
    col = F.when(F.contains(haystack, F.lit(V.BAD_MARKER)), F.lit("spam verification tag"))
    for phrase, reason in zip(V.BAD_PHRASES, V.BAD_PHRASE_REASONS):
        col = col.when(F.contains(low, F.lit(phrase)), F.lit(reason))
    return col.when(F.contains(low, F.lit(V.BAD_URL_FRAGMENT)), F.lit("remoteok job url"))


# ---- row quality ---------------------------------------------------------------------
def is_merged(title: Column, text: Column) -> Column:
    """Does the text look like several listings scraped into one?"""

    def test(body, title_key):
        lines = F.filter(
            F.transform(
                F.split(body, "\n"),
                lambda x: F.btrim(F.regexp_replace(x, r"^[•\-*]\s*", ""), F.lit(EDGE)),
            ),
            lambda x: x != "",
        )
        chrome_re = r"(?i)\b(?:jobs found|showing|filter by|sort by|latest jobs)\b"
        info_re = r"(?i)\b(?:deadline|closing date|apply by|salary|source)\b"

        def count(ls):
            chrome = F.size(F.filter(ls, lambda x: is_noise_line(x) | x.rlike(chrome_re)))
            roles = F.size(
                F.array_distinct(
                    F.transform(
                        F.filter(
                            ls,
                            lambda x: (F.length(x) <= 140)
                            & is_role(x)
                            & ~x.rlike(info_re)
                            & ~x.rlike(chrome_re)
                            & ~is_noise_line(x)
                            & (fold(x) != title_key)
                            & (fold(x) != ""),
                        ),
                        fold,
                    )
                )
            )
            # page chrome is looked for only where it decides
            return (roles >= 3) | ((roles >= 2) & (chrome >= 3))

        return (body != "") & (
            (F.length(body) > 12000)
            | (F.size(repeated_labels(body, V.MERGED_TITLE_LABELS)) > 0)
            | bind(lines, count)
        )

    # the key is bound, or it would be made anew for every line
    return bind(fold(clean_text(title)), lambda k: bind(normalize_block(text), lambda b: test(b, k)))


def low_value(title: Column, apply_url: Column) -> Column:
    t = F.lower(inline(title))
    return (t == "") | t.isin(V.LOW_VALUE_TITLES) | (F.length(t) > V.FORM_MAX_LENGTHS["title"])


def is_public(df, as_of_date: Column) -> Column:
    """Row may be shown: open, one listing, worth showing, no unsafe content."""
    c = {n: F.col(n) for n in df.columns}
    get = lambda n: c.get(n, F.lit(None).cast("string"))
    body = F.coalesce(F.nullif(get("job_description"), F.lit("")), get("summary"))
    return (
        ~closed_strict(get("tags"), get("expires_at"), as_of_date)
        & ~low_value(get("title"), get("apply_url"))
        & ~bad_content(
            [get("title"), get("company"), get("summary"), get("job_description"), get("requirements")],
            [get("apply_url"), get("source_url")],
        )
        & ~is_merged(get("title"), body)
    )


def valid_email(c: Column) -> Column:
    return inline(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def recipients(c: Column) -> Column:
    """Usable addresses among the first 50 of a recipient list, lower case."""
    low = F.transform(F.slice(c, 1, 50), lambda x: F.lower(inline(x)))
    return F.filter(low, lambda x: x.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))


# ---- validation ------------------------------------------------------------------------
def reject_reasons(as_of_date: Column, allowed_locations: Column, skip_expired: Column) -> Column:
    """All rules evaluated on a normalised record; the codes of the failed ones, in order."""
    c = F.col
    text = lambda n: empty_if_null(c(n))
    source = F.coalesce(F.nullif(text("job_description"), F.lit("")), text("summary"))
    place = F.concat_ws(" ", text("location"), text("title"), text("summary"))
    full = F.concat_ws("\n", text("location"), text("title"), text("summary"))
    remote = (
        (text("remote_status") == "Remote")
        | F.contains(F.lower(text("category")), F.lit("remote"))
        | F.contains(F.lower(text("location")), F.lit("remote"))
    )
    outside = (F.size(F.coalesce(allowed_locations, F.array().cast("array<string>"))) > 0) & ~F.exists(
        allowed_locations, lambda t: F.contains(F.lower(place), F.lower(t))
    )

    def with_body(body):
        rules = [(f"{n}_too_long", F.length(text(n)) > m) for n, m in V.RECORD_MAX_LENGTHS.items()]
        rules += [
            ("title_too_short", F.length(text("title")) < 5),
            (
                "title_not_clean",
                (F.length(text("title")) > 120)
                | text("title").rlike(r"(?i)\|\s*(apply by|deadline|closing date|earn|salary)"),
            ),
            ("title_not_real_role", ~is_role(clean_text(c("title")))),
            ("company_missing", F.length(text("company")) < 2),
            ("company_not_clean", ~is_company(clean_text(c("company")))),
            ("summary_too_short", F.length(text("summary")) < 80),
            ("description_missing", body == ""),
            ("description_too_long", F.length(body) > 12000),
            ("probable_merged_listing", is_merged(c("title"), body)),
            ("apply_url_invalid", ~is_web_url(c("apply_url"))),
            ("source_url_invalid", ~is_web_url(c("source_url"))),
            ("expired", skip_expired & F.coalesce(c("expires_at").rlike(ISO_TIME), F.lit(False)) & expired(c("expires_at"), as_of_date)),
            ("outside_allowed_locations", outside),
            (
                "remote_location_restricted",
                remote & full.rlike("(?i)" + V.REMOTE_RESTRICTED) & ~full.rlike("(?i)" + V.REMOTE_ALLOWED),
            ),
            (
                "low_quality_or_spam",
                F.concat_ws(" ", text("title"), text("summary")).rlike("(?i)" + V.SPAM_WORDS),
            ),
            ("marketing_landing_page", text("summary").rlike("(?i)" + V.MARKETING_WORDS)),
            (
                "unsafe_scraped_content",
                bad_content(
                    [c("title"), c("company"), c("summary"), c("job_description"), c("requirements")],
                    [c("apply_url"), c("source_url")],
                ),
            ),
        ]
        return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))

    return bind(normalize_block(source), with_body)


def form_error(columns) -> Column:
    """First failed rule of a submitted row, or null."""
    have = [n for n in V.FORM_MAX_LENGTHS if n in columns]
    text = lambda n: empty_if_null(F.col(n)) if n in columns else F.lit("")
    enums = {
        "category": V.CATEGORIES,
        "employment_type": V.FORM_EMPLOYMENT_TYPES,
        "remote_status": V.FORM_REMOTE_STATUSES,
        "experience_level": V.FORM_EXPERIENCE_LEVELS,
    }
    rules = [(any_of([text(n) == "" for n in V.FORM_REQUIRED]), "required_field_missing")]
    rules += [
        (F.length(text(n)) > V.FORM_MAX_LENGTHS[n], f"{n}_too_long") for n in have
    ]
    rules += [
        ((text(n) != "") & ~text(n).isin(allowed), f"{n}_invalid") for n, allowed in enums.items()
    ]
    rules.append(
        ((text("apply_url") != "") & ~safe_url(text("apply_url")), "apply_url_invalid")
    )
    rules.append(
        (
            bad_content([text(n) for n in ("title", "company", "summary", "job_description", "requirements")],
                        [text("apply_url")]),
            "unsafe_scraped_content",
        )
    )
    date_re = r"^\d{4}-\d{2}-\d{2}(?:\s+\d{2}:\d{2}:\d{2})?$"
    rules += [
        ((text(n) != "") & ~text(n).rlike(date_re), f"{n}_invalid") for n in ("expires_at", "posted_at")
    ]
    return F.coalesce(*[F.when(cond, F.lit(msg)) for cond, msg in rules])


def clean_offer(df):
    """Offer rows with inline text, length caps and an integer priority."""
    limits = {"description": 500, "affiliate_url": 2048}
    cols = {n: F.substring(inline(F.col(n)), 1, limits.get(n, 240)) for n in V.OFFER_FIELDS if n in df.columns}
    cols["priority_score"] = F.coalesce(F.col("priority_score").cast("string").try_cast("int"), F.lit(0))
    return df.withColumns(cols)


def offer_error(columns) -> Column:
    text = lambda n: empty_if_null(F.col(n)) if n in columns else F.lit("")
    return F.coalesce(
        F.when(any_of([text(n) == "" for n in V.OFFER_REQUIRED]), F.lit("required_field_missing")),
        F.when(~safe_url(text("affiliate_url")), F.lit("affiliate_url_invalid")),
        F.when(
            (text("image_url") != "") & ~safe_url(text("image_url")),
            F.lit("image_url_invalid"),
        ),
    )
