"""Number and label formatting for report text.

Numbers are rounded from the exact value of the double, ties to even: 50.25 is a tie and gives 50.2,
while 50.45 is stored a little above and gives 50.5.  Spark's own rounding looks at the shortest decimal
text of a double, for which both are ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropwind.functions.columns import ColumnLike, as_column

#: Scaled values from here on have no fraction.
WHOLE = 2.0**52
#: Splits a double into two halves of 26 bits, whose products with a small whole number are exact.
SPLIT = 2.0**27 + 1.0


def scaled(x: ColumnLike, digits: int) -> Column:
    """``|x| * 10**digits`` as a whole number, rounded half to even from the exact value.

    The product is rounded to a double; what that loses is found exactly from the two halves of
    ``x``, and decides where the product seems to lie half way.
    """
    x, unit = F.abs(as_column(x)), F.lit(float(10**digits))
    product = x * unit
    turned = x * F.lit(SPLIT)
    high = turned - (turned - x)
    lost = (high * unit - product) + (x - high) * unit
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    return (whole + up.cast("int")).cast("bigint")


def _written(x: ColumnLike, digits: int, whole) -> Column:
    x, unit = as_column(x), 10**digits
    value = scaled(x, digits)
    text = whole(F.floor(value / unit).cast("bigint") if digits else value)
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((value % unit).cast("string"), digits, "0"))
    text = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(F.abs(x) * unit < WHOLE, text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def fixed(x: ColumnLike, digits: int) -> Column:
    return _written(x, digits, lambda n: n.cast("string"))


def percent(x: ColumnLike, digits: int = 0) -> Column:
    """A share (0.45) as a percentage text (45%)."""
    return F.concat(fixed(as_column(x) * 100, digits), F.lit("%"))


def grouped(x: ColumnLike, digits: int = 0) -> Column:
    """Thousands separators: 12,345."""
    return _written(x, digits, lambda n: F.format_number(n, 0))


def capitalised(x: ColumnLike) -> Column:
    """First letter upper, all others lower."""
    x = as_column(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def snake(x: ColumnLike) -> Column:
    """Trimmed, lower case, spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(as_column(x))), " ", "_")


def same_text(x: ColumnLike, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(as_column(x)) == F.lit(value.lower())
