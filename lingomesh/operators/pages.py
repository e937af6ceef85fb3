"""Page content from a crawled pages table.

Pages are not downloaded here: a crawler stores ``url, html`` (and, when it has them,
``status``, ``content_type``, ``bytes``, ``location``) and these operators turn that table
into main texts, per-page reasons, resolved redirects and address checks — all as column
expressions, joins and aggregates over the table.
"""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.addresses import V4, ipv6_digits, network_of, v4_in, v4_number
from ..functions.text import bound, col_of, trim_ws, truncate
from ..functions.urls import resolve_url
from ..session import cut_lineage

# element names whose whole content is never main text
RAW_ELEMENTS = ["script", "style", "noscript", "template"]
DROP_ELEMENTS = ["nav", "header", "footer", "aside", "form", "table"]
# element names that break a line
BLOCK_ELEMENTS = "p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|tr|section|article|main|blockquote|pre|figure|figcaption|hr"
_DROP_TAG = f"<(/?)({'|'.join(DROP_ELEMENTS)})(?=[\\s/>])[^>]*>"


# stand-ins for the page's own angle brackets while its references are decoded: code points that are no characters
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_AWAY = {ord(_OPEN): None, ord(_CLOSE): None, ord("<"): _OPEN, ord(">"): _CLOSE}
_BACK = {ord(_OPEN): "<", ord(_CLOSE): ">", ord("<"): "&lt;", ord(">"): "&gt;", ord("&"): "&amp;"}


def _decoded(pages):
    """Character references decoded, but for those of angle brackets and ampersands, which stay ``&lt; &gt; &amp;``
    until the tags are gone.  The table of names is the standard library's."""
    return pages.map(lambda page: html.unescape(page.translate(_AWAY)).translate(_BACK))


def _open_and_cut(state: Column, tag: Column) -> Column:
    """The state (open tags, ranges of chunks to cut) behind a tag.  An end tag closes the last open tag of its element, and the
    range between them takes in the ranges of that element inside it; an end tag without a start is ignored."""
    start = F.array_max(F.transform(F.filter(state["open"], lambda t: t["name"] == tag["name"]), lambda t: t["at"]))
    opened = F.struct(F.concat(state["open"], F.array(F.struct(tag["name"].alias("name"), tag["at"].alias("at")))).alias("open"), state["cut"].alias("cut"))
    outer = F.filter(state["cut"], lambda r: ~((r["name"] == tag["name"]) & (r["first"] > start)))
    closed = F.struct(F.filter(state["open"], lambda t: t["at"] != start).alias("open"),
                      F.concat(outer, F.array(F.struct(tag["name"].alias("name"), start.alias("first"), tag["at"].alias("last")))).alias("cut"))
    return F.when(tag["end"] == "", opened).when(start.isNull(), state).otherwise(closed)


def _tags_of(chunks: Column) -> Column:
    """``name, end, at`` of the chunks that begin with a tag; ``end`` is a slash for end tags."""
    def tag(c: Column, i: Column) -> Column:
        return F.struct(F.lower(F.regexp_extract(c, f"(?is)^{_DROP_TAG}", 2)).alias("name"), F.regexp_extract(c, f"(?is)^{_DROP_TAG}", 1).alias("end"), i.alias("at"))

    return F.filter(F.transform(chunks, tag), lambda t: t["name"] != "")


def without_elements(h: Column) -> Column:
    """``h`` without navigation, header, footer, aside, form and table elements, nested to any depth, each replaced by a space.

    The page is split once, before every tag of these elements.  One pass over the tags keeps, per element, the tags that are
    open; what lies between a start tag and its end tag goes.  A start tag that is never closed cuts nothing.
    The work grows with the number of such tags times the number open at once.
    """
    chunks = F.split(h, f"(?is)(?={_DROP_TAG})")
    none = F.expr("named_struct('open', cast(array() as array<struct<name:string,at:int>>), 'cut', cast(array() as array<struct<name:string,first:int,last:int>>))")

    def kept(page: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            gone = F.exists(page["cut"], lambda r: (r["first"] <= i) & (i < r["last"]))
            behind = F.exists(page["cut"], lambda r: r["last"] == i)
            return F.when(gone, "").when(behind, F.regexp_replace(c, "(?s)^<[^>]*>", " ")).otherwise(c)

        return F.array_join(F.transform(page["chunks"], piece), "")

    return bound(chunks, lambda parts: bound(F.struct(parts.alias("chunks"), F.aggregate(_tags_of(parts), none, _open_and_cut)["cut"].alias("cut")), kept))


def main_text(html_col: Column | str) -> Column:
    """Main text of an HTML page (X17), empty when nothing is left.

    Comments and script / style / navigation / header / footer / aside / form / table elements, nested to
    any depth, are removed; all ``<main>`` parts, else all ``<article>`` parts, else the ``<body>`` are kept (a
    part without an end tag runs to the end of the page); block elements become line breaks,
    other tags vanish, character references are decoded, blanks are collapsed and blank lines
    dropped.
    """
    h = F.pandas_udf(_decoded, "string")(F.coalesce(col_of(html_col).cast("string"), F.lit("")))
    h = F.regexp_replace(h, "(?s)<!--.*?-->", " ")
    for tag in RAW_ELEMENTS:
        h = F.regexp_replace(h, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    h = without_elements(h)

    def parts(tag: str) -> Column:
        return F.array_join(F.regexp_extract_all(h, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|$)"), F.lit(1)), "\n")

    t = (
        F.when(h.rlike("(?i)<main\\b"), parts("main"))
        .when(h.rlike("(?i)<article\\b"), parts("article"))
        .when(h.rlike("(?i)<body\\b"), F.regexp_extract(h, "(?is)<body\\b[^>]*>(.*)$", 1))
        .otherwise(h)
    )
    t = F.regexp_replace(t, f"(?i)</?({BLOCK_ELEMENTS})\\b[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    t = F.regexp_replace(t, "[ \\t\\r\\f\u00a0]+", " ")
    t = F.regexp_replace(t, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", "")


def response_reason(status: Column, content_type: Column, n_bytes: Column, text: Column, max_bytes: int = L.PAGE_MAX_BYTES) -> Column:
    """Why a stored response gives no text, NULL when it does (F15): ``HTTP n``; a non-empty
    content type without ``html``; a body over 5 MB; no extracted text."""
    ctype = F.lower(trim_ws(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when(status.isNull() | (status != 200), F.format_string(L.PAGE_HTTP.replace("{}", "%s"), status.cast("string")))
        .when((ctype != "") & ~ctype.contains("html"), F.format_string(L.PAGE_NOT_HTML.replace("{}", "%s"), ctype))
        .when(F.coalesce(n_bytes, F.lit(0)) > max_bytes, F.lit(L.PAGE_TOO_BIG))
        .when(F.coalesce(text, F.lit("")) == "", F.lit(L.PAGE_NO_TEXT))
    )


def page_texts(pages: DataFrame, max_chars: int | None = None, max_bytes: int = L.PAGE_MAX_BYTES) -> DataFrame:
    """Main text or reason per page (S12): ``pages`` has ``code, pos, html`` and optionally
    ``status, content_type, bytes, url``; returns ``code, pos, text, error`` (and ``url`` where
    there is one) with the text cleaned, and cut if asked, like a text column (X9)."""
    cols = set(pages.columns)
    status = F.col("status").cast("int") if "status" in cols else F.lit(200)
    ctype = F.col("content_type") if "content_type" in cols else F.lit("")
    nbytes = F.col("bytes").cast("long") if "bytes" in cols else F.octet_length("html").cast("long")
    staged = pages.withColumn("__mt", main_text("html"))
    reason = response_reason(status, ctype, nbytes, F.col("__mt"), max_bytes)
    return staged.select(
        "code", "pos", *(["url"] if "url" in cols else []),
        F.when(reason.isNull(), truncate(F.col("__mt"), max_chars)).otherwise(F.lit("")).alias("text"),
        reason.alias("error"),
    )


def page_cache_rows(texts: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows for a page-text cache table (S11): ``url, text`` of the successes, texts whole."""
    return texts.where(F.col("error").isNull()).select(F.col(url_col).alias("url"), "text").dropDuplicates(["url"])


def cached_page_texts(pages: DataFrame, cache: DataFrame, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts of ``pages`` (needs ``url``) with hits of ``cache(url, text)`` taken as they are, and
    the new rows for the cache (S11): only misses are extracted."""
    known = cache.select(F.col("url").alias("__u"), F.col("text").alias("__hit"))
    fresh = page_texts(pages.join(known, F.col("url") == F.col("__u"), "left_anti"), max_chars)
    hits = (pages.select("code", "pos", "url").join(known, F.col("url") == F.col("__u"))
            .select("code", "pos", "url", truncate(F.col("__hit"), max_chars).alias("text"), F.lit(None).cast("string").alias("error")))
    return fresh.unionByName(hits), page_cache_rows(fresh)


# ---------------------------------------------------------------------------------------
# address guard

_V6_NETWORKS = [("loopback", L.IPV6_LOOPBACK), ("never", L.IPV6_NEVER), ("public", L.IPV6_PUBLIC_INSIDE), ("private", L.IPV6_PRIVATE)]


def address_kind(ip: Column) -> Column:
    """Kind of a literal address: ``loopback``, ``never``, ``private``, ``public`` or ``bad``.  IPv4
    (also mapped into IPv6) by integer ranges, IPv6 by the first network of the table that holds it."""
    n = v4_number(ip)
    v4 = (
        F.when(v4_in(n, L.IPV4_LOOPBACK), "loopback").when(v4_in(n, L.IPV4_NEVER + L.IPV4_SHARED), "never")
        .when(v4_in(n, L.IPV4_PRIVATE), "private").otherwise("public")
    )
    v6 = F.coalesce(network_of(ipv6_digits(ip), _V6_NETWORKS, "public"), F.lit("bad"))
    return F.when(F.lower(ip).rlike(V4), v4).otherwise(v6)


def address_forbidden(kind: Column, allow_loopback: bool = False, allow_private: bool = False) -> Column:
    allowed = ["public"] + ["loopback"] * allow_loopback + ["private"] * allow_private
    return ~F.coalesce(kind, F.lit("bad")).isin(*allowed)


_URL_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?"


def url_guard(
    urls: DataFrame,
    url_col: str,
    host_ips: DataFrame,
    allow_loopback: bool = False,
    allow_private: bool = False,
) -> DataFrame:
    """``urls`` plus ``guard_reason`` (NULL = allowed).

    ``host_ips(host, ip)`` is the resolution table (one row per address of a host); a host
    without rows is unresolvable; one forbidden address forbids the host.  Literal IP hosts
    are tested directly.  The address test runs once per *distinct* address.
    """
    s = trim_ws(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    scheme = F.lower(F.regexp_extract(s, _URL_PARTS, 1))
    netloc = F.regexp_extract(s, _URL_PARTS, 2)
    hostport = F.regexp_replace(netloc, "(?s)^.*@", "")
    bracketed = hostport.startswith("[")
    host = F.lower(
        F.when(bracketed, F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(hostport, ":", 1))
    )
    port = F.when(bracketed, F.regexp_extract(hostport, r"^\[[^\]]*\](?::(.*))?$", 1)).otherwise(
        F.when(hostport.contains(":"), F.regexp_replace(hostport, "^[^:]*:", "")).otherwise(F.lit(""))
    )
    bad_brackets = (netloc.contains("[") != netloc.contains("]")) | (bracketed & ~hostport.rlike(r"^\[[^\]]*\](:.*)?$"))
    digits = F.regexp_replace(port, "^0+", "")
    bad_port = (port != "") & (~port.rlike("^[0-9]+$") | (F.length(digits) > 5) | F.coalesce(digits.try_cast("long") > 65535, F.lit(False)))
    literal = host.rlike(V4) | host.contains(":")
    staged = urls.withColumns({
        "__scheme": scheme, "__host": host, "__literal": literal,
        "__invalid": bad_brackets | bad_port,
    })
    addr = (
        staged.where(F.col("__literal") & (F.col("__host") != "")).select(F.col("__host").alias("host"), F.col("__host").alias("ip"))
        .unionByName(host_ips.select(F.lower("host").alias("host"), F.col("ip").cast("string").alias("ip")))
    )
    distinct_ips = addr.select("ip").distinct()
    verdict = distinct_ips.withColumn("bad", address_forbidden(address_kind(F.col("ip")), allow_loopback, allow_private))
    per_host = (
        addr.join(verdict, "ip").groupBy("host").agg(F.bool_or("bad").alias("__bad_host"))
    )
    joined = staged.join(per_host, staged["__host"] == per_host["host"], "left").drop("host")
    reason = (
        F.when(F.col("__invalid"), F.lit(L.GUARD_INVALID))
        .when(~F.col("__scheme").isin("http", "https"), F.lit(L.GUARD_SCHEME))
        .when(F.col("__host") == "", F.lit(L.GUARD_NO_HOST))
        .when(F.col("__bad_host").isNull(), F.lit(L.GUARD_UNRESOLVED))
        .when(F.col("__bad_host"), F.lit(L.GUARD_INTERNAL))
    )
    return joined.withColumn("guard_reason", reason).drop("__scheme", "__host", "__literal", "__invalid", "__bad_host")


# ---------------------------------------------------------------------------------------
# redirects


def resolve_redirects(
    starts: DataFrame,
    log: DataFrame,
    guard: DataFrame | None = None,
    max_hops: int = L.MAX_REDIRECTS,
) -> DataFrame:
    """Follow stored redirects (J11): ``starts(url)``, ``log(url, status, location)``.

    Each round joins the frontier to the log once (all start URLs together); relative
    locations are resolved against the current URL; at most ``max_hops`` redirects.
    ``guard(url, guard_reason)`` optionally forbids hops: the first URL keeps its own
    reason, a later hop gives ``Weiterleitung zu unzulässiger Adresse``.
    Returns ``url, final_url, hops, status, reason``.
    """
    lg = log.select(F.col("url").alias("cur"), F.col("status").cast("int").alias("st"), F.col("location").alias("loc"))
    front = starts.select("url", F.col("url").alias("cur"), F.lit(0).alias("hops"))
    done_parts = []
    g = guard.select(F.col("url").alias("cur"), F.col("guard_reason").alias("gr")) if guard is not None else None
    for _ in range(max_hops + 1):
        step = front.join(lg, "cur", "left")
        if g is not None:
            step = step.join(g, "cur", "left")
        else:
            step = step.withColumn("gr", F.lit(None).cast("string"))
        is_redirect = F.col("st").isin(*L.REDIRECT_STATUSES) & F.col("loc").isNotNull() & (F.col("loc") != "")
        blocked = F.col("gr").isNotNull()
        # whatever the guard table holds: a hop to another scheme is refused
        foreign = ~F.col("cur").rlike("(?i)^https?://")
        reason = (
            F.when(blocked & (F.col("hops") == 0), F.col("gr"))
            .when(blocked | (foreign & (F.col("hops") > 0)), F.lit(L.REDIRECT_FORBIDDEN))
            .when(is_redirect & (F.col("hops") >= max_hops), F.lit(L.REDIRECT_TOO_MANY))
        )
        step = step.withColumn("reason", reason).withColumn("__more", reason.isNull() & is_redirect)
        # each round is written once: the next round and the result both read it
        step = cut_lineage(step)
        done_parts.append(step.where(~F.col("__more")).select(
            "url", F.col("cur").alias("final_url"), "hops", F.col("st").alias("status"), "reason"
        ))
        front = step.where(F.col("__more")).select("url", resolve_url(F.col("cur"), F.col("loc")).alias("cur"),
                                                    (F.col("hops") + 1).alias("hops"))
    out = done_parts[0]
    for p in done_parts[1:]:
        out = out.unionByName(p)
    return out
