"""Vector expressions (X2, X3, X18, X19) as native Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType

from ..labels import NUMBER_PATTERN
from .text import col_of, text_or_empty, trim_ws

FLT_MAX = 3.4028234663852886e38
FLT_TRUE_MIN = 1.401298464324817e-45


def _to_float(x: Column) -> Column:
    # parse as double first, then round to float32, like parsing to a Python float does
    return x.try_cast("double").cast("float")


def parse_vector_text(value: Column | str) -> Column:
    """Parse embedding text to ``array<float>`` (X2); NULL when unreadable.

    A flat JSON array of numbers (number-like strings, true/false and null accepted) is
    read as JSON; anything else, or a JSON array that fails, is read as every number the
    fixed number pattern finds.  No number at all gives NULL.
    """
    s = trim_ws(text_or_empty(col_of(value)))
    blank = (s == "") | (F.lower(s) == "nan")
    bracketed = s.startswith("[") & s.endswith("]")
    elems = F.from_json(F.when(bracketed, s), "array<string>")

    def elem_value(e: Column) -> Column:
        unq = F.regexp_replace(e, '^"(.*)"$', "$1")
        return (
            F.when(e.isNull(), F.lit(float("nan")).cast("float"))
            .when(e == "true", F.lit(1.0).cast("float"))
            .when(e == "false", F.lit(0.0).cast("float"))
            .otherwise(_to_float(unq))
        )

    def elem_ok(e: Column) -> Column:
        return e.isNull() | e.isin("true", "false") | (F.regexp_replace(e, '^"(.*)"$', "$1")).try_cast("double").isNotNull()

    json_ok = elems.isNotNull() & (F.size(elems) > 0) & F.forall(elems, elem_ok)
    from_json_vec = F.transform(elems, elem_value)
    numbers = F.regexp_extract_all(s, F.lit(NUMBER_PATTERN), 0)
    regex_vec = F.when(F.size(numbers) > 0, F.transform(numbers, _to_float))
    return F.when(blank, F.lit(None).cast("array<float>")).when(json_ok, from_json_vec).otherwise(regex_vec)


def as_vector(value: Column | str, dtype: DataType) -> Column:
    """Vector of any supported column type: typed numeric arrays are used directly
    (empty → NULL), text is parsed."""
    c = col_of(value)
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, NumericType):
        floats = F.transform(c, lambda x: F.coalesce(x.cast("float"), F.lit(float("nan")).cast("float")))
        return F.when(F.size(c) > 0, floats)
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StringType):
        return parse_vector_text(F.concat(F.lit("["), F.array_join(c, ",", "null"), F.lit("]")))
    return parse_vector_text(c)


def sum_squares(vec: Column | str) -> Column:
    return F.aggregate(col_of(vec), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm_invalid(sumsq: Column) -> Column:
    """Zero, NaN or infinite norm — judged at float32 range, where the contract computes it."""
    return sumsq.isNull() | F.isnan(sumsq) | (sumsq < FLT_TRUE_MIN) | (sumsq > FLT_MAX)


def l2_normalize(vec: Column | str, sumsq: Column) -> Column:
    """Divide by the L2 norm and store float32.

    The norm enters as an argument array, not inside the lambda: the optimizer may inline
    a projected norm into a lambda body, which would re-sum the vector for every element.
    """
    v = col_of(vec)
    norms = F.array_repeat(F.sqrt(sumsq), F.size(v))
    return F.zip_with(v, norms, lambda x, n: (x.cast("double") / n).cast("float"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Exact double dot product of two vectors (X19 reference form)."""
    prods = F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def vector_json(vec: Column | str, decimals: int = 6) -> Column:
    """``[x,…]`` with a fixed number of decimals, re-readable by :func:`parse_vector_text`."""
    fmt = f"%.{decimals}f"
    return F.concat(F.lit("["), F.array_join(F.transform(col_of(vec), lambda x: F.format_string(fmt, x.cast("double"))), ","), F.lit("]"))
