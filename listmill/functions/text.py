"""Text normalisation as column expressions (all JVM side)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

# White space and "not a word character" in the Unicode sense, spelled out so that
# Java and RE2 read them the same way.
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"
WS_IN_LINE = r"[\t\x0B\f\r \x1c-\x1f\x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"
# runs of the same sets for regexp_replace by one space alone: a first test that nearly every character fails spares the
# rest of the class, and a run that is one space is left as it is
_WS_SET = r"[[^!-~]&&[\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]]"
_NON_WORD_SET = r"[[^a-z]&&[^\p{L}\p{N}_]]"
WS_RUN = rf"(?! [!-~]){_WS_SET}+"
NON_WORD_RUN = rf"(?! [a-z]){_NON_WORD_SET}+"
BLANK_RUN = r"[\t\f\x0B][ \t\f\x0B]*| [ \t\f\x0B]+"
# one of them is in every text that BLANK_RUN changes
_BLANK_RUNS = ("  ", "\t", "\f", "\x0b")
# every character of WS; \p{Z} spelled out
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EDGE = " \t\r\n-|•"
# white space beyond ASCII, and the ASCII kinds besides space and line feed
_RARE_WS = r"[\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ODD_WS = "\t\x0b\f\r\x1c\x1d\x1e\x1f"
BULLET_START = r"^\s*(?:[•●▪◦‣]+|[-*]+)\s+"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def null_if_empty(c: Column) -> Column:
    """Null for an empty text. ``nullif`` would evaluate ``c`` twice inside a lambda or a branch."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def has(t: Column, *signs: str) -> Column:
    """Whether one of the signs is in ``t``: a plain search, far cheaper than a pattern that finds nothing."""
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signs])


def _spaced(t: Column, *also: str) -> Column:
    """Whether white space other than single spaces and line feeds, or one of ``also``, may be in ``t``."""
    return has(t, *also, "  ", *_ODD_WS) | ((F.length(t) != F.octet_length(t)) & t.rlike(_RARE_WS))


def words_pattern(words) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def _code_point(entity: Column) -> Column:
    digits = F.regexp_extract(entity, "([0-9a-fA-F]+);", 1)
    number = F.when(F.lower(F.substring(entity, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(
        digits
    )
    number = F.expr("bigint(0)") + F.coalesce(number.try_cast("bigint"), F.lit(0))
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    ).otherwise(F.lit("\ufffd"))


def _resolved(t: Column) -> Column:
    """``t`` with its character references resolved; it is evaluated once."""

    def numeric(t):
        found = F.regexp_extract_all(
            t, F.lit("(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1)
        )
        return F.aggregate(
            F.array_distinct(found), t, lambda acc, e: F.replace(acc, e, _code_point(e))
        )

    named = reduce(
        lambda x, kv: F.replace(x, F.lit(f"&{kv[0]};"), F.lit(kv[1])), V.ENTITIES.items(), t
    )
    done = bind(named, lambda n: F.when(F.contains(n, F.lit("&#")), numeric(n)).otherwise(n))
    return F.replace(done, F.lit("&amp;"), F.lit("&"))


def unescape(c: Column) -> Column:
    """Resolve character references: the known names and every numeric one."""
    return bind(c, lambda t: F.when(F.contains(t, F.lit("&")), _resolved(t)).otherwise(t))


def plain(c: Column) -> Column:
    """References resolved, no-break space as space, zero-width marks out, LF line ends."""

    def signs(t):
        for sign, other in (("\u00a0", " "), ("\u200b", ""), ("\ufeff", ""), ("\r\n", "\n"), ("\r", "\n")):
            t = F.replace(t, F.lit(sign), F.lit(other))
        return t

    return bind(
        empty_if_null(c),
        lambda t: F.when(F.contains(t, F.lit("&")), signs(_resolved(t)))
        .when(has(t, "\u00a0", "\u200b", "\ufeff", "\r"), signs(t))
        .otherwise(t),
    )


def clean_text(c: Column, keep_lines: bool = False) -> Column:
    t = plain(c)
    if keep_lines:

        def lines(t):
            done = F.regexp_replace(t, BLANK_RUN, " ")
            done = F.regexp_replace(strip(done), f"{WS_IN_LINE}*\n{WS_IN_LINE}*", "\n")
            return F.regexp_replace(done, r"\n{3,}", "\n\n")

        # most texts give the patterns nothing to do
        t = bind(t, lambda x: F.when(_spaced(x, " \n", "\n ", "\n\n\n"), lines(x)).otherwise(strip(x)))
    else:
        t = F.regexp_replace(t, WS_RUN, " ")
    return F.btrim(t, F.lit(EDGE))


def one_line(c: Column) -> Column:
    """One line of text whose character references are resolved already."""
    return F.btrim(F.regexp_replace(c, WS_RUN, " "), F.lit(EDGE))


def one_line_of(x: Column, c: Column) -> Column:
    """``one_line(c)`` of a part of ``x``, a lambda variable or column: where that has single spaces only, no pattern runs."""
    return F.btrim(F.when(_spaced(x, "\n"), F.regexp_replace(c, WS_RUN, " ")).otherwise(c), F.lit(EDGE))


def is_blank(c: Column) -> Column:
    """Whether ``inline(c)`` would be empty; nothing beyond the first other character is read."""
    return ~empty_if_null(c).rlike(r"[^\x00-\x20\x7f\x85\p{Z}]")


def inline(c: Column) -> Column:
    """One line of text: control characters and white space runs become one space."""
    t = F.regexp_replace(empty_if_null(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(t, WS_RUN, " "))


def fold(c: Column) -> Column:
    """Comparison key of a text: lower case, runs of non-word characters to one space."""
    return F.trim(F.regexp_replace(F.lower(c), NON_WORD_RUN, " "))


def cut_at_word(c: Column, limit: int, drop: str = ".,;:-") -> Column:
    """At most ``limit`` characters, ending on a whole word."""

    def cut(t):
        short = F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", "")
        return F.when(F.length(t) > limit, F.rtrim(short, F.lit(drop))).otherwise(t)

    return bind(c, cut)


def first_of_each_key(lines: Column, key, keep_unkeyed: bool) -> Column:
    """Keep the first line of each key, in order; blank lines always stay.

    Sort by (key, position), keep group heads, sort back: n log n in the lines of a row.
    """
    tagged = F.array_sort(
        F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    )

    def heads(s):
        def is_head(e, j):
            new = ~F.get(s, j - 1)["k"].eqNullSafe(e["k"])
            free = (e["x"] == "") | ((e["k"] == "") if keep_unkeyed else F.lit(False))
            # a blank line also has an empty key, so unkeyed heads need their own test
            if not keep_unkeyed:
                prev = F.get(s, j - 1)
                new = new | ((e["k"] == "") & (prev["x"] == ""))
            return free | new

        kept = F.filter(s, is_head)
        back = F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
        return F.transform(back, lambda e: e["x"])

    return bind(tagged, heads)


MAYBE_NOISE = r"(?i)^[^\p{L}\p{N}]*(?:\z|\d|" + "|".join(V.NOISE_STARTS) + ")"


def is_noise_line(line: Column) -> Column:
    """Is the line page chrome? ``line`` is a lambda variable or a column; most lines fail the first word's test."""
    return line.rlike(MAYBE_NOISE) & bind(
        one_line_of(line, F.regexp_replace(line, r"^[•\-*]\s*", "")),
        lambda b: (b == "")
        | b.isin(V.INFERRED_CATEGORIES)
        | b.rlike("(?i)" + V.NOISE_LINE)
        | b.rlike("(?i)" + V.CATEGORY_HEADING_LINE),
    )


def block_lines(c: Column) -> Column:
    """Lines of a text block with bullets on their own lines and one bullet sign."""

    def split(t):
        parted = F.regexp_replace(t, r"(\S)\s+[•●▪◦‣]\s+", "$1\n• ")
        blanks = lambda x: F.regexp_replace(x, BLANK_RUN, " ")
        return F.split(F.when(has(t, *"•●▪◦‣"), blanks(parted)).when(has(t, *_BLANK_RUNS), blanks(t)).otherwise(t), "\n")

    return F.transform(bind(plain(c), split), lambda x: F.regexp_replace(strip(x), BULLET_START, "• "))


def _join_block(lines: Column) -> Column:
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return strip(text)


def normalize_block(
    c: Column, max_chars: int | None = None, noise: bool = True, dedupe: bool = True
) -> Column:
    """Multi-line text without page chrome, repeated lines or runs of blank lines."""
    lines = block_lines(c)
    if noise:
        lines = F.filter(lines, lambda x: (x == "") | ~is_noise_line(x))
    if dedupe:
        lines = first_of_each_key(lines, fold, keep_unkeyed=True)
    text = _join_block(lines)
    return cut_at_word(text, max_chars) if max_chars else text


def schema_text(c: Column) -> Column:
    """Block cleaner of the published documents: a repeated unkeyed line goes as well."""

    def split(t):
        return F.split(F.when(has(t, *_BLANK_RUNS), F.regexp_replace(t, BLANK_RUN, " ")).otherwise(t), "\n")

    lines = F.transform(bind(plain(c), split), strip)
    return _join_block(first_of_each_key(lines, fold, keep_unkeyed=False))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def strip_source(c: Column) -> Column:
    kept = F.filter(paragraphs(schema_text(c)), lambda p: ~p.rlike(r"(?i)^source\s*:"))
    return F.array_join(kept, "\n\n")


def to_paragraphs(c: Column) -> Column:
    """Plain text as safe HTML paragraphs."""

    def wrap(p):
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            p = F.replace(p, F.lit(raw), F.lit(safe))
        return F.concat(F.lit("<p>"), F.regexp_replace(p, r"\n+", "<br>"), F.lit("</p>"))

    return F.array_join(F.transform(paragraphs(schema_text(c)), wrap), "")


def slug(c: Column, markup: bool = False) -> Column:
    t = empty_if_null(c)
    if markup:
        t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
        t = unescape(F.regexp_replace(t, r"<[^>]+>", " "))
    return F.btrim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-"), F.lit("-"))


def strip_tail(c: Column) -> Column:
    """Clean title without deadline, salary and workplace tails."""
    t = c
    for tail in V.TITLE_TAILS:
        t = F.regexp_replace(t, "(?i)" + tail, "")
    t = F.regexp_replace(t, "(?i)" + V.TITLE_WORKPLACE_TAG, " ")
    return one_line(F.regexp_replace(t, r"\s+[-–—|:]\s*$", ""))


def strip_title(c: Column) -> Column:
    return strip_tail(clean_text(c))


def content_hash(cols) -> Column:
    parts = [F.when(empty_if_null(c) != "", F.lower(clean_text(c))) for c in cols]
    return F.sha2(F.regexp_replace(F.concat_ws("|", *parts), NON_WORD_RUN, " "), 256)


def keywords(*cols: Column) -> Column:
    """Distinct search words: plural s off first, then short and stop words out."""
    text = F.lower(F.concat_ws(" ", *[empty_if_null(c) for c in cols]))
    words = F.transform(
        F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1)),
        lambda w: F.when(
            (F.length(w) > 4) & F.endswith(w, F.lit("s")), F.substr(w, F.lit(1), F.length(w) - 1)
        ).otherwise(w),
    )
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.filter(
        F.array_distinct(words), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)
    )


def tag_list(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(empty_if_null(c), "[,;|]"), strip), lambda t: t != "")
    return F.slice(parts, 1, 8)


def tag_keys(c: Column) -> Column:
    keys = F.transform(tag_list(c), lambda t: F.array_join(F.array_sort(keywords(t)), " "))
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def delimited_set(c: Column) -> Column:
    parts = F.transform(F.split(F.lower(empty_if_null(c)), "[,;|]"), strip)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def truncate_meta(c: Column, limit: int = 160) -> Column:
    def cut(t):
        short = F.rtrim(F.regexp_replace(F.substring(t, 1, limit + 1), r" [^ ]*$", ""), F.lit(".,;:-"))
        short = F.coalesce(null_if_empty(short), F.rtrim(F.substring(t, 1, limit)))
        return F.when(F.length(t) <= limit, t).otherwise(short)

    return bind(c, cut)


def meta_description(title: Column, company: Column, location: Column, text: Column) -> Column:
    t, co, lo = inline(title), inline(company), inline(location)
    name = F.when((t != "") & (co != ""), F.concat_ws(" at ", t, co)).otherwise(F.concat(t, co))
    place = F.when(lo != "", F.concat(F.lit("- "), lo))
    intro = F.concat_ws(" ", null_if_empty(name), place)
    body = inline(normalize_block(text, max_chars=260))
    return truncate_meta(F.concat_ws(". ", null_if_empty(intro), null_if_empty(body)))


def email_key(c: Column) -> Column:
    return F.substring(F.sha2(F.lower(empty_if_null(c)), 256), 1, 12)
