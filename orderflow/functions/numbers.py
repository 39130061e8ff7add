"""Number parsing. ANSI mode is on by default, so every cast is a try-cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Shape of a decimal number.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def decimal_comma(text: Column) -> Column:
    """``"2,50"`` to 2.5; NULL when the text is no number, as ``"1.000,00"``."""
    point = F.replace(text, F.lit(","), F.lit("."))
    # The cast alone would also take Java suffixes such as "10f".
    return F.when(point.rlike(NUMBER), point.try_cast("double"))


def truncated(text: Column) -> Column:
    """Decimal-comma text cut to its whole part."""
    value = decimal_comma(text)
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double")


def whole(text: Column) -> Column:
    return text.try_cast("double")


def plain_quantity(qty: Column) -> Column:
    """Text of a quantity: no decimals when it is integral."""
    return F.when(qty == F.floor(qty), F.floor(qty).cast("string")).otherwise(
        qty.cast("string")
    )


def percent(part: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 for an empty total."""
    return F.when(total > 0, F.floor(part * 100 / total)).otherwise(F.lit(0)).cast("long")
