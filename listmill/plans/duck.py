"""Pieces of DuckDB SQL that state a column rule a second time, for the comparison."""

from ..functions import vocab as V

# RE2 spelling of the character classes of ``functions.text``
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\p{Z}]"
WS_IN_LINE = r"[\t\x0B\f\r \x1c-\x1f\x{85}\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"
EDGE = "' ' || chr(9) || chr(13) || chr(10) || '-|•'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c, pattern, to="", flags="g"):
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, '{flags}')"


def hit(c, pattern, flags="i"):
    return f"regexp_matches({c}, {q(pattern)}, '{flags}')"


def group(c, pattern, n=1, flags="i"):
    return f"regexp_extract({c}, {q(pattern)}, {n}, '{flags}')"


def word(c, words):
    """Whole-word match without look-around."""
    return hit(c, r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])")


def plain(c):
    t = f"coalesce({c}, '')"
    for name, ch in V.ENTITIES.items():
        t = f"replace({t}, {q('&' + name + ';')}, {q(ch)})"
    t = f"replace({t}, '&amp;', '&')"
    t = f"translate({t}, chr(160) || chr(8203) || chr(65279), ' ')"
    return f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"


def clean(c, keep_lines=False):
    t = plain(c)
    if keep_lines:
        t = rx(t, r"[ \t\f\x0B]+", " ")
        t = rx(t, f"^{WS}+|{WS}+$")
        t = f"regexp_replace({t}, {q(WS_IN_LINE + '*' + chr(10) + WS_IN_LINE + '*')}, chr(10), 'g')"
        t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    else:
        t = rx(t, f"{WS}+", " ")
    return f"trim({t}, {EDGE})"


def fold(c):
    return f"trim({rx(f'lower({c})', NON_WORD, ' ')})"


def inline(c):
    return f"trim({rx(rx(f'coalesce({c}, {q(chr(39)*0)})', r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' '), WS + '+', ' ')})"


def first_of(cases, default="NULL"):
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END)"


def any_contains(c, words):
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def day(c):
    """First ten characters as a date, null when they are not one."""
    s = f"substr({c}, 1, 10)"
    return f"(CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({s} AS DATE) END)"


def iso_day(c):
    s = f"regexp_extract(coalesce({c}, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}')"
    return f"try_cast(nullif({s}, '') AS DATE)"


AS_OF = "TIMESTAMP '2024-07-01 00:00:00'"
AS_OF_DATE = "DATE '2024-07-01'"

CLOSED = (
    "(contains(',' || replace(replace(lower(coalesce(tags, '')), ';', ','), '|', ',') || ',', ',closed,') "
    f"OR (expires_at IS NOT NULL AND trim(expires_at) <> '' AND {day('expires_at')} < {AS_OF_DATE}))"
)
ACTIVE = f"(NOT {CLOSED})"
CLOSED_STRICT = (
    "(list_contains(list_transform(regexp_split_to_array(lower(coalesce(tags, '')), '[,;|]'), lambda t: trim(t)), 'closed') "
    f"OR coalesce({iso_day('expires_at')} < {AS_OF_DATE}, false))"
)
BAD = (
    "(contains({t}, " + q(V.BAD_MARKER) + ") OR "
    + " OR ".join("contains(lower({t}), " + q(p) + ")" for p in V.BAD_PHRASES) + ")"
)


def bad_url(c):
    t = f"lower(trim(coalesce({c}, '')))"
    starts = " OR ".join(f"starts_with({t}, {q(p)})" for p in V.BAD_URL_PREFIXES)
    return f"({starts} OR {hit(t, r'^(?:[^:/?#]+:)?//(?:www[.])?remoteok[.]com/remote-jobs', '')})"


BOUNDARY_L = r"(^|[^\p{L}\p{N}_])"
BOUNDARY_R = r"($|[^\p{L}\p{N}_])"


def is_role(c):
    return (
        f"(length({c}) BETWEEN 5 AND 120 AND {word(c, V.ROLE_WORDS)}"
        f" AND NOT {hit(c, V.GENERIC_TITLE + BOUNDARY_R)}"
        f" AND NOT {hit(c, V.TASK_VERB_START + BOUNDARY_R)}"
        f" AND NOT {hit(c, BOUNDARY_L + V.TITLE_REQUIREMENT_WORDS + BOUNDARY_R)}"
        f" AND NOT {hit(c, BOUNDARY_L + '(?:(?:is|are)[ ]+hiring|apply[ ]+by|deadline|closing[ ]+date)' + BOUNDARY_R)})"
    )


def is_company(c):
    names = ", ".join(q(x) for x in V.NOT_A_COMPANY)
    return (
        f"(length({c}) BETWEEN 2 AND 90 AND lower({c}) NOT IN ({names})"
        f" AND NOT {hit(c, V.BAD_COMPANY_START + BOUNDARY_R)}"
        f" AND NOT {hit(c, BOUNDARY_L + V.BAD_COMPANY_VERB + BOUNDARY_R)}"
        f" AND length({c}) - length(replace({c}, ' ', '')) < 8"
        f" AND NOT {hit(c, '[.!?]')} AND {hit(c, '[A-Za-z0-9]')})"
    )


def is_noise(x):
    bare = f"trim({rx(rx(x, r'^[•\-*]\s*', '', ''), WS + '+', ' ')}, {EDGE})"
    cats = ", ".join(q(c) for c in V.INFERRED_CATEGORIES)
    return f"({bare} = '' OR {bare} IN ({cats}) OR {hit(bare, V.NOISE_LINE)} OR {hit(bare, V.CATEGORY_HEADING_LINE)})"


def strip(c):
    return rx(c, f"^{WS}+|{WS}+$")


def block_lines(c):
    t = f"regexp_replace({plain(c)}, '(\\S)\\s+[•●▪◦‣]\\s+', '\\1' || chr(10) || '• ', 'g')"
    t = rx(t, r"[ \t\f\x0B]+", " ")
    line = rx(strip("x"), r"^\s*(?:[•●▪◦‣]+|[-*]+)\s+", "• ", "")
    return f"list_transform(string_split({t}, chr(10)), lambda x: {line})"


def join_block(lines):
    t = f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def block_ctes(name, src, text, noise=True, out="block"):
    """CTEs that add the cleaned block of ``text`` to the rows of ``src``."""
    lines = block_lines(text)
    if noise:
        lines = f"list_filter({lines}, lambda x: x = '' OR NOT {is_noise('x')})"
    kept = "list_filter(_l, lambda x, i: x = '' OR _k[i] = '' OR list_position(_k, _k[i]) = i)"
    return [
        f"{name}_l AS (SELECT *, {lines} AS _l FROM {src})",
        f"{name}_k AS (SELECT *, list_transform(_l, lambda x: {fold('x')}) AS _k FROM {name}_l)",
        f"{name} AS (SELECT * EXCLUDE (_l, _k), {join_block(kept)} AS {out} FROM {name}_k)",
    ]


def cut_at_word(c, n, drop=".,;:-"):
    cut = f"regexp_replace(substr({c}, 1, {n}), ' [^ ]*$', '')"
    return f"(CASE WHEN length({c}) > {n} THEN rtrim({cut}, {q(drop)}) ELSE {c} END)"


def merged(title, block):
    labels = " OR ".join(
        "len(list_distinct(list_filter(list_transform(regexp_extract_all("
        + block + ", " + q(r"(?im)^\s*(?:[•\-*]\s*)?" + lab + r"\s*:?\s*([^\n]{2,140})") + ", 1), lambda x: "
        + fold("x") + "), lambda x: x <> ''))) > 1"
        for lab in V.MERGED_TITLE_LABELS
    )
    lines = (
        f"list_filter(list_transform(string_split({block}, chr(10)), lambda x: "
        f"trim({rx('x', r'^[•\-*]\s*', '', '')}, {EDGE})), lambda x: x <> '')"
    )
    chrome = f"({is_noise('x')} OR {word('x', ['jobs found', 'showing', 'filter by', 'sort by', 'latest jobs'])})"
    info = word("x", ["deadline", "closing date", "apply by", "salary", "source"])
    roles = (
        f"len(list_distinct(list_transform(list_filter({lines}, lambda x: length(x) <= 140 AND {is_role('x')} AND NOT {info}"
        f" AND NOT {chrome} AND {fold('x')} <> {fold(clean(title))} AND {fold('x')} <> ''), lambda x: {fold('x')})))"
    )
    n_chrome = f"len(list_filter({lines}, lambda x: {chrome}))"
    return (
        f"({block} <> '' AND (length({block}) > 12000 OR {labels} OR {roles} >= 3 OR ({n_chrome} >= 3 AND {roles} >= 2)))"
    )


def low_value(title):
    names = ", ".join(q(x) for x in V.LOW_VALUE_TITLES)
    t = f"lower({inline(title)})"
    return f"({t} = '' OR {t} IN ({names}) OR length({t}) > 140)"


def bad_row(cols):
    text = "concat_ws(chr(10), " + ", ".join(f"coalesce({c}, '')" for c in cols) + ")"
    urls = " OR ".join(bad_url(c) for c in cols)
    return f"({BAD.replace('{t}', text)} OR {hit(text, '(?s)please mention the word.{0,240}tag[ ]+[a-z0-9+/=]{12,}')} OR {urls})"


BAD_COLS = ["title", "company", "summary", "job_description", "requirements", "apply_url", "source_url"]


def public_ctes(src="jobs", name="pub"):
    """CTEs down to ``name``: rows of ``src`` with a boolean ``is_public``."""
    return block_ctes(f"{name}_b", src, "coalesce(nullif(job_description, ''), summary)") + [
        f"{name} AS (SELECT * EXCLUDE (block), (NOT {CLOSED_STRICT} AND NOT {low_value('title')} AND NOT {bad_row(BAD_COLS)}"
        f" AND NOT {merged('title', 'block')}) AS is_public FROM {name}_b)"
    ]


def slug(c):
    return f"trim({rx(f'lower(coalesce({c}, {q(chr(0)[:0])}))', '[^a-z0-9]+', '-')}, '-')"


URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def url_part(c, n):
    return f"regexp_extract({c}, {q(URL)}, {n})"


def is_web(c):
    return f"regexp_matches(coalesce({c}, ''), '^(?i)https?://[^/?#]')"


def keywords(c):
    words = (
        f"list_transform(regexp_extract_all(lower(coalesce({c}, '')), '([a-z0-9]+)', 1), "
        "lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END)"
    )
    stop = ", ".join(q(w) for w in V.STOP_WORDS)
    return f"list_distinct(list_filter({words}, lambda w: length(w) >= 3 AND w NOT IN ({stop})))"


def set_text(lst):
    return f"array_to_string(list_sort({lst}), ' ')"
