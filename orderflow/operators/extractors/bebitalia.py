"""Furniture purchase orders: S-code, description, unit and quantity on a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import FULL_DATE, day_month_year
from orderflow.functions.numbers import truncated
from orderflow.functions.text import (
    all_matches,
    first_match,
    first_of,
    let,
    squeeze,
)
from orderflow.operators.extractors.common import first_per_code, item

# Client and shapes of this layout.
CLIENT = "B&B ITALIA S.p.A."
CLIENT_MARK = "B&B ITALIA"
NUMBER = r"\d{11}-\d+"
LONG_NUMBER = r"\d{10,}-\d+"
PRICED_DATE = rf"\d+[.,]\d+\s+({FULL_DATE})\s*$"
RECEIVED = rf"DATA\s+DOCUMENTO[^0-9]*({FULL_DATE})"
ITEM = r"(S\d+)\s+([^\n]*?)\s+(?:PZ|NR)\s+([\d,]+)"


def header(text: Column, path: Column) -> dict[str, Column]:
    # Second smallest distinct valid date, else the only one.
    spare = let(
        F.array_sort(
            F.array_distinct(
                F.array_compact(F.transform(all_matches(text, FULL_DATE), day_month_year))
            )
        ),
        lambda d: F.coalesce(F.get(d, F.lit(1)), F.get(d, F.lit(0))),
    )
    long_numbers = F.filter(
        all_matches(text, LONG_NUMBER), lambda n: ~F.startswith(n, F.lit("0"))
    )
    return {
        "client": F.when(F.contains(F.upper(text), F.lit(CLIENT_MARK)), CLIENT),
        "order_no": F.coalesce(first_match(text, NUMBER, 0), first_of(long_numbers)),
        "due": F.coalesce(day_month_year(first_match(text, PRICED_DATE, 1, "m")), spare),
        "received": day_month_year(first_match(text, RECEIVED, 1, "i")),
    }


def items(text: Column) -> Column:
    found = F.transform(
        all_matches(text, ITEM),
        lambda x: item(
            first_match(x, ITEM, 1),
            squeeze(F.coalesce(first_match(x, ITEM, 2), F.lit(""))),
            truncated(first_match(x, ITEM, 3)),
        ),
    )
    # A code with an unreadable quantity still hides its later repeats.
    return F.filter(first_per_code(found), lambda x: x["qty"].isNotNull())
