"""Small building blocks for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a plain decimal number in a text cell
NUMBER_CELL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# fixed values: the white space that trimming removes
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only; stops at the first other character."""
    return ~F.coalesce(text.cast("string").rlike(r"(?U)\S"), F.lit(False))


def plain_number(text: Column) -> Column:
    """DOUBLE of a cell that is a plain decimal number, else NULL."""
    cell = text.cast("string")
    return F.when(cell.rlike(NUMBER_CELL), F.trim(cell).try_cast("double"))


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else NULL.

    The plain parser stops after the first value; inside brackets anything left over is an
    error or a second element.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(single, F.try_variant_get(listed, "$[0]", "variant"))


def float_divide(a: Column, b: Column) -> Column:
    """``a / b`` of doubles by the floating-point rules: over zero it is infinite or NaN, no error."""
    by_zero = (
        F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    )
    # NaN sorts above everything in a comparison, but is no infinity when divided.
    return F.when(b != 0, a / b).when(F.isnan(a), a).otherwise(F.when(b == 0, by_zero))


def float_log(value: Column) -> Column:
    """Natural logarithm by the floating-point rules: zero gives -Infinity, below zero is NaN."""
    return (
        F.when(value > 0, F.log(value))
        .when(value == 0, F.lit(float("-inf")))
        .when(value < 0, F.lit(float("nan")))
    )


def round6(value: Column) -> Column:
    return F.round(value, 6)
