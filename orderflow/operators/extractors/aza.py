"""Supplier orders whose item lines are read token by token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import LOOSE_SLASH_DATE, SLASH_DATE, day_month_year
from orderflow.functions.numbers import truncated
from orderflow.functions.text import first_match, let, matches, rx, strip
from orderflow.operators.extractors.common import NO_NAME, accepted, item, no_quantity, refused
from orderflow.operators.lines import stripped_lines

# Marks and limits of this layout.
CLIENT = r"AZA\s+INTERNATIONAL[^\n]*"
NUMBER_DATED = r"(\d+)(?:/|-)?AC\s+del"
NUMBER_PLAIN = r"(\d+)/AC"
DUE = rf"DATA\s+CONSEGNA.*?{SLASH_DATE}"
LINE_START, MIN_LENGTH, MIN_TOKENS = "NR", 30, 8
CODE_TOKEN = r"^[A-Z0-9]{4,}$"
QTY_AT, NAME_FROM = 1, 4
CURRENCY = "[€Ç]"


def header(text: Column, path: Column) -> dict[str, Column]:
    return {
        "client": strip(first_match(text, CLIENT, 0)),
        "order_no": F.coalesce(
            first_match(text, NUMBER_DATED, 1, "i"), first_match(text, NUMBER_PLAIN)
        ),
        "due": day_month_year(first_match(text, DUE, 1, "is")),
        "received": day_month_year(first_match(text, LOOSE_SLASH_DATE)),
    }


def _line_item(line: Column) -> Column:
    """The code is the last capital token; the name runs from token 4 up to it."""

    def read(tokens: Column) -> Column:
        code_at = F.array_max(
            F.array_compact(
                F.transform(
                    tokens,
                    lambda t, i: F.when((i >= NAME_FROM) & matches(t, CODE_TOKEN), i),
                )
            )
        )
        return let(
            code_at,
            lambda at: item(
                F.get(tokens, at),
                strip(
                    F.regexp_replace(
                        F.array_join(
                            F.slice(
                                tokens,
                                F.lit(NAME_FROM + 1),
                                F.greatest(F.coalesce(at, F.lit(0)) - NAME_FROM, F.lit(0)),
                            ),
                            " ",
                        ),
                        CURRENCY,
                        "",
                    )
                ),
                F.when(
                    (F.size(tokens) >= MIN_TOKENS) & (at > NAME_FROM),
                    truncated(F.get(tokens, F.lit(QTY_AT))),
                ),
            ),
        )

    return let(F.split(line, rx(r"\s+"), -1), read)


def _found(text: Column) -> Column:
    lines = F.filter(
        stripped_lines(text),
        lambda x: F.startswith(x, F.lit(LINE_START)) & (F.length(x) >= MIN_LENGTH),
    )
    return F.transform(lines, _line_item)


def _why_not(x: Column) -> Column:
    named = F.coalesce(F.length(x["name"]) > 0, F.lit(False))
    return F.coalesce(no_quantity(x), F.when(~named, NO_NAME))


def items(text: Column) -> Column:
    return accepted(_found(text), _why_not)


def rejects(text: Column) -> Column:
    """Lines of articles without a quantity or a name, with the reason."""
    return refused(_found(text), _why_not)
