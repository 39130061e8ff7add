"""Kitchen-division orders: one line per item, code and hyphens, then quantity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import ANY_DATE, day_month_year
from orderflow.functions.numbers import whole
from orderflow.functions.text import BLANK, all_matches, first_match, matches, strip
from orderflow.operators.extractors.common import item

# Client, labels and line shapes of this layout.
CLIENT = "DIVISIONE CUCINE"
CLIENT_MARK = r"DIVISIONE\s+CUCINE"
NUMBER = r"N\.\s*(\d{3}\s*\d{3}\s*\d{3})"
DUE_LABELS = "CONSEGNA RICHIESTA|DELIVERY DATE"
RECEIVED = r"(?:Data\s*/\s*Date|Date\s*/\s*Date)\s+" + f"({ANY_DATE})"
ITEM = rf"^{BLANK}*\d+([A-Z0-9]{{10,}})-{{4,}}{BLANK}+NR{BLANK}+(\d+)(.*)$"

# First label line whose next line holds a date; group 1 is that next line.
DUE_LINE = rf"^[^\n]*(?:{DUE_LABELS})[^\n]*\n([^\n]*{ANY_DATE}[^\n]*)"


def header(text: Column, path: Column) -> dict[str, Column]:
    dates = all_matches(first_match(text, DUE_LINE, 1, "im"), ANY_DATE)
    due = F.coalesce(F.get(dates, F.lit(1)), F.get(dates, F.lit(0)), text)
    return {
        "client": F.when(matches(text, CLIENT_MARK, "i"), CLIENT),
        "order_no": F.replace(first_match(text, NUMBER, 1, "i"), F.lit(" "), F.lit("")),
        "due": day_month_year(due),
        "received": day_month_year(first_match(text, RECEIVED, 1, "i")),
    }


def items(text: Column) -> Column:
    part = lambda line, g: first_match(line, ITEM, g)
    return F.transform(
        all_matches(text, ITEM, 0, "m"),
        lambda x: item(
            part(x, 1),
            strip(F.coalesce(part(x, 3), F.lit(""))),
            whole(part(x, 2)),
        ),
    )
