"""Language-code expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..labels import CODE_PATTERN, X_DEFAULT
from .text import col_of, text_or_empty, trim_ws


def _stripped(c: Column | str) -> Column:
    return trim_ws(text_or_empty(c))


def code_shape(c: Column) -> Column:
    """True when ``c`` (already stripped) is ``xx`` or ``xx-yy`` in any case."""
    return c.rlike("(?i)" + CODE_PATTERN)


def is_valid_code(c: Column | str) -> Column:
    s = _stripped(c)
    return code_shape(s) & (F.lower(s) != X_DEFAULT)


def normalize_code(c: Column | str) -> Column:
    """``xx`` or ``xx-YY`` for valid codes, else the stripped input unchanged."""
    s = _stripped(c)
    parts = F.split(s, "-")
    cased = F.concat_ws("-", F.lower(F.get(parts, F.lit(0))), F.upper(F.get(parts, F.lit(1))))
    return F.when(code_shape(s), cased).otherwise(s)


def language_of(c: Column | str) -> Column:
    """Language part of a code: text before the first '-', lower-cased."""
    return F.lower(F.substring_index(_stripped(c), "-", 1))


def normalize_code_py(code: str | None) -> str:
    """Driver-side twin for the handful of parameter codes (pivot, x-default)."""
    text = (code or "").strip()
    language, dash, region = text.partition("-")
    shape = [len(part) == 2 and part.isascii() and part.isalpha() for part in (language, region)]
    if not shape[0] or (dash and not shape[1]):
        return text
    return language.lower() + dash + region.upper()


__all__ = [
    "is_valid_code", "normalize_code", "language_of", "col_of", "normalize_code_py",
]
