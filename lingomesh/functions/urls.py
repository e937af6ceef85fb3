"""URL expressions (X1, X6, X7, X8) written with native regex and array functions.

No UDF: every function here returns a Column that stays inside whole-stage codegen
(the query-string part uses higher-order functions, which Spark interprets per row but
still on the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..labels import CCTLD_LANG, TRACKING_PARAMS
from .codes import code_shape, language_of, normalize_code
from .text import col_of, text_or_empty, trim_ws

_SPLIT = r"(?s)^[^:]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_IPV6ISH = r"(?i)^(v[0-9a-f]+\..+|[0-9a-f.]*:[0-9a-f:.]*(%.*)?)$"


def _with_scheme(s: Column) -> Column:
    """Prefix ``https://`` unless the text starts with http(s)://, then drop TAB/CR/LF
    (the URL splitter of the contract ignores them)."""
    prefixed = F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    return F.regexp_replace(prefixed, "[\\t\\r\\n]", "")


def _netloc_unparsable(netloc: Column) -> Column:
    has_open = netloc.contains("[")
    has_close = netloc.contains("]")
    inner = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    return (has_open != has_close) | (has_open & has_close & ~inner.rlike(_IPV6ISH))


def _hostname(netloc: Column) -> Column:
    """Host of a net location: after the last '@', inside brackets or before ':', lower-cased."""
    h = F.regexp_replace(netloc, "(?s)^.*@", "")
    h = F.when(h.contains("["), F.regexp_extract(h, r"\[([^\]]*)", 1)).otherwise(F.substring_index(h, ":", 1))
    return F.lower(h)


def _unquote_plus(x: Column) -> Column:
    # A bare '%' is kept literally, as the contract's decoder does.
    fixed = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(fixed), x)


def _quote_plus(x: Column) -> Column:
    # Java's form encoder differs from the contract's on exactly '~' and '*'.
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _canonical_query(q: Column) -> Column:
    pieces = F.filter(F.split(q, "&"), lambda x: x != "")
    pairs = F.transform(
        pieces,
        lambda x: F.struct(
            _unquote_plus(F.substring_index(x, "=", 1)).alias("k"),
            _unquote_plus(F.regexp_replace(x, "^[^=]*=?", "")).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
    ordered = F.array_sort(kept)
    return F.array_join(F.transform(ordered, lambda p: F.concat(_quote_plus(p["k"]), F.lit("="), _quote_plus(p["v"]))), "&")


def _normalized_parts(s0: Column, netloc: Column, path: Column, query: Column) -> Column:
    host = F.regexp_replace(_hostname(netloc), r"^www\.", "")
    p1 = F.regexp_replace(path, ";[^/]*$", "")
    p = F.when(p1.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(p1, "/+$", ""))
    qs = _canonical_query(query)
    result = F.concat(host, p, F.when(qs != "", F.concat(F.lit("?"), qs)).otherwise(F.lit("")))
    return (
        F.when((s0 == "") | (F.lower(s0) == "nan"), F.lit(""))
        .when(_netloc_unparsable(netloc), s0)
        .otherwise(result)
    )


def normalize_url(url: Column | str) -> Column:
    """Matching key of a URL, without scheme: ``example.com/de/seite?a=1``.

    Host lower-cased without port, user info and one leading ``www.``; path kept as is
    except ``;params`` of the last segment and trailing slashes; query pairs decoded,
    tracking parameters removed, sorted by (key, value) and re-encoded; fragment dropped.
    Blank or ``nan`` gives ""; an unparsable net location gives the stripped input.

    Single-expression form; :func:`with_normalized_url` computes the same in staged
    projections, which compiles far smaller code on wide tables.
    """
    s0 = trim_ws(text_or_empty(col_of(url)))
    s1 = _with_scheme(s0)
    return _normalized_parts(
        s0, F.regexp_extract(s1, _SPLIT, 1), F.regexp_extract(s1, _SPLIT, 2), F.regexp_extract(s1, _SPLIT, 3)
    )


def with_normalized_url(df: DataFrame, url: str, out: str = "norm_url") -> DataFrame:
    """``df`` plus column ``out`` = :func:`normalize_url` of ``url``, computed in stages
    so every intermediate value is evaluated once per row."""
    t = "__nu_"
    staged = df.withColumn(t + "s0", trim_ws(text_or_empty(F.col(url))))
    staged = staged.withColumn(t + "s1", _with_scheme(F.col(t + "s0")))
    staged = staged.withColumns({
        t + "net": F.regexp_extract(F.col(t + "s1"), _SPLIT, 1),
        t + "path": F.regexp_extract(F.col(t + "s1"), _SPLIT, 2),
        t + "q": F.regexp_extract(F.col(t + "s1"), _SPLIT, 3),
    })
    staged = staged.withColumn(
        out, _normalized_parts(F.col(t + "s0"), F.col(t + "net"), F.col(t + "path"), F.col(t + "q"))
    )
    return staged.drop(t + "s0", t + "s1", t + "net", t + "path", t + "q")


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """(host lower-cased, path or '/') of a URL; malformed gives ('', '/')."""
    s0 = trim_ws(text_or_empty(col_of(url)))
    s1 = _with_scheme(s0)
    netloc = F.regexp_extract(s1, _SPLIT, 1)
    path = F.regexp_replace(F.regexp_extract(s1, _SPLIT, 2), ";[^/]*$", "")
    bad = _netloc_unparsable(netloc)
    host = F.when(bad, F.lit("")).otherwise(_hostname(netloc))
    path = F.when(bad | (path == ""), F.lit("/")).otherwise(path)
    return host, path


def _first_segment(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(1))


def cctld_lang(tld: Column) -> Column:
    """Language of a top-level domain, "" when none or unknown."""
    lookup = F.create_map(*[F.lit(x) for kv in CCTLD_LANG.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, tld), F.lit(""))


def code_candidate(url: Column | str) -> Column:
    """Language-code guess of one URL (X7): code-shaped first path segment, else a
    two-letter first label of a host with at least three labels, else the ccTLD map."""
    host, path = host_and_path(url)
    seg = _first_segment(path)
    labels = F.split(host, r"\.")
    first = labels.getItem(0)
    tld = F.element_at(labels, -1)
    seg_ok = seg.isNotNull() & code_shape(seg)
    sub_ok = (F.size(labels) >= 3) & (F.length(first) == 2) & (first != "www") & code_shape(first)
    return (
        F.when(seg_ok, normalize_code(seg))
        .when(sub_ok, F.lower(first))
        .otherwise(cctld_lang(tld))
    )


def strip_language(norm_url: Column | str, code: Column | str) -> Column:
    """Slug key (X8): drop the host and a first path segment that names the language
    of ``code``; result ``*/rest``."""
    s = text_or_empty(col_of(norm_url))
    code_c = col_of(code) if not isinstance(code, str) else F.lit(code)
    slash = F.instr(s, "/")
    path = F.when(slash > 0, s.substr(slash, F.length(s))).otherwise(F.lit("/"))
    lang = language_of(code_c)
    first = F.lower(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit("")))
    same = (first != "") & (
        (first == F.lower(code_c)) | (first == lang) | (code_shape(first) & (language_of(first) == lang))
    )
    rest = F.regexp_replace(path, "^/[^/]*/?", "/")
    return F.concat(F.lit("*"), F.when(same, rest).otherwise(path))


_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(path: Column) -> Column:
    """RFC 3986 dot segments removed; a path that ends in one ends in a slash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: (
        F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part)))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference resolved against an absolute http(s) URL (RFC 3986, section 5.2); a reference
    with a scheme or an authority of its own is taken as it is."""
    b = {n: F.regexp_extract(base, _PARTS, i) for i, n in enumerate(("scheme", "authority", "path", "query"), 1)}
    r = {n: F.regexp_extract(ref, _PARTS, i) for i, n in enumerate(("scheme", "authority", "path", "query", "fragment"), 1)}
    root = F.concat(b["scheme"], F.lit(":"), b["authority"])
    folder = F.regexp_replace(b["path"], "[^/]*$", "")
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), r["path"])
    same_file = F.concat(root, b["path"], F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"])
    return (
        F.when(r["scheme"] != "", ref)
        .when(r["authority"] != "", F.concat(b["scheme"], F.lit(":"), ref))
        .when(r["path"] == "", same_file)
        .otherwise(F.concat(root, _without_dots(F.when(r["path"].startswith("/"), r["path"]).otherwise(merged)), r["query"], r["fragment"]))
    )
