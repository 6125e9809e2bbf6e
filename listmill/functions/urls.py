"""URL columns. Split by pattern so that malformed input gives nulls, never errors."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import bind, empty_if_null, inline, null_if_empty

# groups: scheme, authority, path, query, fragment (RFC 3986 appendix B)
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(c: Column, n: int) -> Column:
    return F.regexp_extract(c, PARTS, n)


def scheme(c: Column) -> Column:
    return F.lower(part(c, 1))


def host(c: Column) -> Column:
    return F.lower(part(c, 2))


def path(c: Column) -> Column:
    return part(c, 3)


def query(c: Column) -> Column:
    return part(c, 4)


def is_web_url(c: Column) -> Column:
    return empty_if_null(c).rlike(r"^(?i)https?://[^/?#]")


def remove_dot_segments(p: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path with one fold over its segments."""

    def folded(q):
        done = F.array_join(
            F.aggregate(
                F.filter(F.split(q, "/"), lambda s: s != "."),
                F.array().cast("array<string>"),
                lambda acc, s: F.when(
                    s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
                ).otherwise(F.concat(acc, F.array(s))),
            ),
            "/",
        )
        ends_open = q.rlike(r"/\.{1,2}$")
        return F.when(ends_open, F.concat(F.rtrim(done, F.lit("/")), F.lit("/"))).otherwise(done)

    return bind(p, lambda q: F.when(q.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), folded(q)).otherwise(q))


def resolve(c: Column, base: Column) -> Column:
    """Reference resolution against a base URL."""

    def against(t, b):
        root = F.concat(part(b, 1), F.lit("://"), part(b, 2))
        base_path = F.coalesce(null_if_empty(path(b)), F.lit("/"))
        rel_query = F.when(F.contains(t, F.lit("?")), F.concat(F.lit("?"), query(t))).otherwise(F.lit(""))
        folder = F.regexp_replace(base_path, r"[^/]*$", "")
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
            .when(F.startswith(t, F.lit("//")), F.concat(part(b, 1), F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(root, remove_dot_segments(path(t)), rel_query))
            .when(F.startswith(t, F.lit("?")), F.concat(root, base_path, rel_query))
            .when((t == "") | F.startswith(t, F.lit("#")), b)
            .otherwise(F.concat(root, remove_dot_segments(F.concat(folder, path(t))), rel_query))
        )

    return bind(c, lambda t: bind(base, lambda b: against(t, b)))


def normalize_url(c: Column, base: Column | None = None) -> Column:
    """Absolute http(s) URL without fragment, or empty."""

    def absolute(t):
        if base is None:
            return t
        return bind(base, lambda b: F.when(is_web_url(b), resolve(t, b)).otherwise(t))

    def done(t):
        usable = (t != "") & (F.length(t) <= 2048)
        return bind(
            absolute(t),
            lambda u: F.when(usable & is_web_url(u), F.regexp_replace(u, "#.*$", "")).otherwise(F.lit("")),
        )

    return bind(F.regexp_replace(empty_if_null(c), r"[\x00-\x20\x7f]+", ""), done)


def _pairs(q: Column) -> Column:
    """Decoded (key, value) pairs of a query string."""

    def dec(s):
        plain_s = F.replace(s, F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(s), plain_s)

    return F.transform(
        F.filter(F.split(q, "&"), lambda s: s != ""),
        lambda s: F.struct(
            dec(F.regexp_extract(s, "^([^=]*)", 1)).alias("k"),
            dec(F.regexp_extract(s, "^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )


def _encode(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))),
        "&",
    )


def url_key(c: Column) -> Column:
    """Key under which two spellings of one address agree; empty when not a web URL."""
    ignored = F.array(*[F.lit(p) for p in V.TRACKING_PARAMS])

    def key(u):
        pairs = F.filter(
            F.transform(_pairs(query(u)), lambda p: F.struct(F.lower(p["k"]).alias("k"), p["v"].alias("v"))),
            lambda p: ~F.array_contains(ignored, p["k"]),
        )
        q = null_if_empty(_encode(F.array_sort(pairs)))
        stem = F.concat(host(u), F.lower(F.rtrim(path(u), F.lit("/"))))
        return F.when(is_web_url(u), F.concat_ws("?", stem, q)).otherwise(F.lit(""))

    return bind(empty_if_null(c), key)


def bad_url(c: Column) -> Column:
    starts = "|".join(p.replace(".", r"\.") for p in V.BAD_URL_PREFIXES)
    return F.ltrim(empty_if_null(c)).rlike(
        rf"(?i)^(?:{starts}|(?:[^:/?#]+:)?//(?:www\.)?remoteok\.com/remote-jobs)"
    )


def job_path(job_id: Column, title: Column, slug_of) -> Column:
    return F.concat(F.lit("/job/"), job_id.cast("string"), F.lit("/"), slug_of(title))


def public_url(c: Column, base: str) -> Column:
    """Same-host, canonical, non-private URL, or null."""
    site = base.rstrip("/")
    root = re.match(r"^[^:/?#]+://[^/?#]*", site).group(0)
    site_host = root.split("://", 1)[1].lower()
    # a path below a private prefix, or the prefix itself without its closing slash
    private = "|".join(f"{p[1:]}|{p.strip('/')}$" for p in V.PRIVATE_PREFIXES)

    def absolute(raw):
        return (
            F.when(raw.rlike("^https?://"), raw)
            .when(F.startswith(raw, F.lit("/")), F.concat(F.lit(site), raw))
            .when(raw != "", F.concat(F.lit(site + "/"), raw))
        )

    def check(u):
        p = F.coalesce(null_if_empty(path(u)), F.lit("/"))
        ok = (
            is_web_url(u)
            & (host(u) == site_host)
            & (query(u) == "")
            & (part(u, 5) == "")
            & ~p.rlike(f"^/*(?:{private})")
        )
        return F.when(ok, F.concat(F.lit(root), p))

    return bind(bind(F.trim(empty_if_null(c)), absolute), check)


def with_default_params(url: Column, defaults) -> Column:
    """Add query parameters that are not there yet; present ones keep their value."""

    def extend(u):
        def pairs_of(present):
            names = F.transform(present, lambda p: p["k"])
            extra = F.array(
                *[
                    F.when(
                        v.isNotNull() & ~F.array_contains(names, F.lit(k)),
                        F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")),
                    )
                    for k, v in defaults
                ]
            )
            # of a repeated parameter the last value counts
            last = F.filter(
                present,
                lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]),
            )
            return F.concat(last, F.array_compact(extra))

        q = null_if_empty(_encode(bind(_pairs(query(u)), pairs_of)))
        stem = F.concat(part(u, 1), F.lit("://"), part(u, 2), path(u))
        return F.concat_ws("#", F.concat_ws("?", stem, q), null_if_empty(part(u, 5)))

    return bind(url, extend)


def redact_url(c: Column) -> Column:
    """URL for logs: sensitive query values hidden, long ones cut, fragment dropped."""
    hidden = "(?i)" + "|".join(V.SENSITIVE_KEY_PARTS)

    def shown(p):
        cut = F.when(
            F.length(p["v"]) > 200, F.concat(F.substring(p["v"], 1, 200), F.lit("...[truncated]"))
        ).otherwise(p["v"])
        v = F.when(p["k"].rlike(hidden), F.lit("[redacted]")).otherwise(cut)
        return F.struct(p["k"].alias("k"), v.alias("v"))

    def redacted(u):
        q = null_if_empty(_encode(F.transform(_pairs(query(u)), shown)))
        scheme_part = F.regexp_extract(u, "^([^:/?#]+:)", 1)
        authority = F.when(u.rlike("^(?:[^:/?#]+:)?//"), F.concat(F.lit("//"), part(u, 2))).otherwise(F.lit(""))
        return F.concat_ws("?", F.concat(scheme_part, authority, path(u)), q)

    return bind(empty_if_null(c), redacted)


def safe_url(c: Column) -> Column:
    return bind(
        inline(c), lambda t: (t != "") & (F.length(t) <= 2048) & is_web_url(t) & ~bad_url(t)
    )
