"""Orders printed one value per line, cut into blocks at the article codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import ANY_DATE, LONG_YEAR_DATE, day_month_year
from orderflow.functions.numbers import decimal_comma
from orderflow.functions.text import all_matches, first_match, first_of, let, matches
from orderflow.operators.extractors.common import item
from orderflow.operators.lines import (
    blocks,
    blocks_ending,
    first_within,
    indexes_where,
    stripped_lines,
)

# Client, line shapes and limits of this layout.
CLIENT_MARK, DEFAULT_CLIENT = "DECA", "DECA S.r.l."
CLIENT = r"DECA\s+S\.?r\.?l\.?"
NUMBER = r"A\s*(\d{3,})"
ANY_CODE_LINE = r"^\d{2}[A-Z]{2,}[A-Z0-9\-]+$"
ITEM_CODE_LINE = r"^25[A-Z]{2}[A-Z0-9\-]*$"
DATE_LINE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
DATE_SPAN = 4
RECEIVED_LINE = r"^(?=[^\n]*(?:[Dd]ata|[Dd]ocumento))[^\n]*?" + f"({ANY_DATE})"
QTY_LINE = r"^\d+[.,]\d+$"
JOB_LINE = r"^[A-Z]\d{2}-\d+(-\d+)?$"
NAME_FROM, MIN_NAME = 2, 3


def header(text: Column, path: Column) -> dict[str, Column]:
    dated = first_within(
        stripped_lines(text),
        lambda x: matches(x, ANY_CODE_LINE),
        lambda x: matches(x, DATE_LINE),
        DATE_SPAN,
    )
    second = F.get(all_matches(text, ANY_DATE), F.lit(1))
    received = F.coalesce(
        first_match(text, RECEIVED_LINE, 1, "m"), first_match(text, LONG_YEAR_DATE, 0)
    )
    return {
        "client": F.when(
            F.contains(F.upper(text), F.lit(CLIENT_MARK)),
            F.coalesce(first_match(text, CLIENT, 0, "i"), F.lit(DEFAULT_CLIENT)),
        ),
        "order_no": F.concat(F.lit("A"), first_match(text, NUMBER)),
        "due": day_month_year(F.coalesce(dated, second)),
        "received": day_month_year(received),
    }


def _name(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit("|")))
    return F.array_join(kept, " ")


def _item_before(block: Column) -> Column:
    """Code first, then a job line, the name, and the quantity."""
    lines = block["lines"]
    return let(
        first_of(indexes_where(lines, lambda x: matches(x, QTY_LINE))),
        lambda q: item(
            first_of(lines),
            _name(
                F.slice(
                    lines,
                    F.lit(NAME_FROM + 1),
                    F.greatest(F.coalesce(q, F.lit(0)) - NAME_FROM, F.lit(0)),
                )
            ),
            decimal_comma(F.get(lines, q)),
        ),
    )


def _item_after(block: Column) -> Column:
    """Name, quantity, then the code: the name starts after the last job line."""
    lines = block["lines"]
    quantity = first_of(indexes_where(lines, lambda x: matches(x, QTY_LINE)))
    return let(
        quantity,
        lambda q: let(
            F.array_max(
                F.filter(
                    indexes_where(lines, lambda x: matches(x, JOB_LINE)), lambda j: j < q
                )
            ),
            lambda job: item(
                F.element_at(lines, F.lit(-1)),
                _name(
                    F.slice(
                        lines,
                        F.coalesce(job, F.lit(-1)) + 2,
                        F.greatest(
                            F.coalesce(q, F.lit(0)) - F.coalesce(job, F.lit(-1)) - 1,
                            F.lit(0),
                        ),
                    )
                ),
                decimal_comma(F.get(lines, q)),
            ),
        ),
    )


def items(text: Column, code_position: str = "before") -> Column:
    """Items of a text, one for each code line with a name and a quantity.

    ``before`` pairs a code with what follows it; ``after`` with what
    precedes it, as in prints where the code closes its article.
    """
    cut, read = (
        (blocks, _item_before) if code_position == "before" else (blocks_ending, _item_after)
    )
    found = cut(stripped_lines(text), lambda x: matches(x, ITEM_CODE_LINE))
    return F.filter(
        F.transform(found, read),
        lambda x: x["qty"].isNotNull() & (F.length(x["name"]) >= MIN_NAME),
    )
