"""Pieces shared by the layout extractors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.text import contains_any, let, matches, strip

ITEM_TYPE = "array<struct<code:string,name:string,qty:double>>"
# Words that show a description is a table heading.
HEADING_WORDS = ["descrizione", "prodotto"]
# Lines that are no company name.
ADDRESS_LINE = r"^(VIA|TEL|FAX|EMAIL|MAIL|PAGE|N\.|DATA|NUMERO|CODICE)"


def item(code: Column, name: Column, qty: Column) -> Column:
    return F.struct(code.alias("code"), name.alias("name"), qty.alias("qty"))


def no_items() -> Column:
    return F.array().cast(ITEM_TYPE)


def plausible(qty: Column, most: float | None = None) -> Column:
    """A positive quantity; ``most`` sets an upper bound, which is off by default."""
    return (qty > 0) & (qty <= most) if most else qty > 0


def no_heading(name: Column) -> Column:
    return ~contains_any(F.lower(name), HEADING_WORDS)


# Why an item found in a text is no article.
NO_QUANTITY, HEADING, SHORT_CODE, NO_NAME = "quantity", "heading", "code", "name"


def refused(items: Column, reason) -> Column:
    """Items for which ``reason(item)`` is not NULL, with that reason.

    With ``accepted`` of the same items it gives every item that was found.
    """
    judged = F.transform(
        items,
        lambda x: F.struct(
            x["code"].alias("code"), x["name"].alias("name"), x["qty"].alias("qty"), reason(x).alias("reason")
        ),
    )
    return F.filter(judged, lambda x: x["reason"].isNotNull())


def accepted(items: Column, reason) -> Column:
    return F.filter(items, lambda x: reason(x).isNull())


def no_quantity(x: Column) -> Column:
    """A quantity that is missing or not above zero."""
    return F.when(~F.coalesce(plausible(x["qty"]), F.lit(False)), NO_QUANTITY)


def known_client(path: Column, clients: Sequence[tuple[str, str]]) -> Column:
    """Client whose key occurs in the path; the first key of the list wins."""
    chosen = F.lit(None).cast("string")
    for key, client in reversed(clients):
        chosen = F.when(F.contains(path, F.lit(key)), F.lit(client)).otherwise(chosen)
    return chosen


def company_name(text: Column) -> Column:
    """First company line of a converted text, not an address."""
    lines = F.transform(F.split(text, "\n", -1), strip)

    def named(line: Column) -> Column:
        legal = (F.contains(line, F.lit("S.r.l")) & matches(line, r"\p{Lu}")) | contains_any(
            line, ["SpA", "S.p.A"]
        )
        return legal & F.length(line).between(4, 99) & ~matches(F.upper(line), ADDRESS_LINE)

    return F.get(F.filter(lines, named), F.lit(0))


def first_per_code(primary: Column, secondary: Column | None = None) -> Column:
    """Drop repeated codes, keeping order.

    With one list, the first item of each code stays. With two, all primary
    items stay and the secondary ones only bring codes not seen before.
    Sorting makes equal codes neighbours, so the work is n log n.
    """

    def tagged(items: Column, rank: int) -> Column:
        return F.transform(
            items,
            lambda x, i: F.struct(
                x["code"].alias("code"),
                F.lit(rank).alias("rank"),
                i.alias("i"),
                x["name"].alias("name"),
                x["qty"].alias("qty"),
            ),
        )

    if secondary is None:
        merged = tagged(primary, 1)
    else:
        merged = F.concat(tagged(primary, 0), tagged(secondary, 1))
    kept = let(
        F.array_sort(merged),
        lambda s: F.filter(
            s,
            lambda x, i: (x["rank"] == 0)
            | (i == 0)
            | (F.get(s, i - 1)["code"] != x["code"]),
        ),
    )
    in_order = F.array_sort(
        F.transform(
            kept,
            lambda x: F.struct(
                x["rank"].alias("rank"),
                x["i"].alias("i"),
                x["code"].alias("code"),
                x["name"].alias("name"),
                x["qty"].alias("qty"),
            ),
        )
    )
    return F.transform(in_order, lambda x: item(x["code"], x["name"], x["qty"]))
