"""Text helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware whitespace: Java's (?U)\s plus the four separators U+001C..U+001F that
# Python's str.strip() also removes.
WS = "[\\s\\x1c-\\x1f]"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where the body uses it inside a lambda
    (a named column would be put back into the lambda by the optimizer)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column | str) -> Column:
    """Strip leading and trailing Unicode whitespace (Spark's trim only removes spaces)."""
    return F.regexp_replace(col_of(c), f"(?U)^{WS}+|{WS}+$", "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """NULL, empty, or the words 'nan' / 'none' after stripping."""
    return F.lower(trim_ws(text_or_empty(c))).isin("", "nan", "none")


def truncate(c: Column | str, max_chars: int | None = None) -> Column:
    """Collapse whitespace runs to one space, strip, cut to ``max_chars`` code points if given."""
    whole = trim_ws(F.regexp_replace(text_or_empty(c), f"(?U){WS}+", " "))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def build_text(cols: list[Column | str], max_chars: int | None = None) -> Column:
    """Truncate each column, skip empty parts, join with a blank line, cut the total if asked."""
    parts = F.array(*[truncate(c, max_chars) for c in cols])
    joined = F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


def html_escape(c: Column | str) -> Column:
    """Escape & < > " ' the way HTML attribute values need it."""
    out = F.replace(col_of(c), F.lit("&"), F.lit("&amp;"))
    for src, dst in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def link_tag(code: Column | str, url: Column | str) -> Column:
    """``<link rel="alternate" hreflang="…" href="…" />``."""
    return F.concat(
        F.lit('<link rel="alternate" hreflang="'), col_of(code),
        F.lit('" href="'), html_escape(url), F.lit('" />'),
    )
