"""Document layouts: ordered recognition rules and the extractor of each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import matches
from orderflow.operators.extractors import (
    aza,
    bebitalia,
    divisione,
    for_ordine,
    generic,
    oafa,
    ordine_ls,
)


@dataclass(frozen=True)
class Layout:
    """One layout.

    ``recognise(text, upper)`` gives a boolean column; ``header(text, path)``
    a dict of client, order_no, due and received; ``items(text)`` an array of
    code, name and qty. Texts with fewer than ``min_items`` items call for the
    table text, which ``reads_tables`` layouts can use; a missing client of a
    ``client_from_tables`` layout is looked for there too. ``rejects(text)`` gives
    the items that were found and refused, each with a reason.
    """

    name: str
    recognise: Callable[[Column, Column], Column]
    header: Callable[[Column, Column], dict[str, Column]]
    items: Callable[[Column], Column]
    min_items: int = 1
    reads_tables: bool = True
    client_from_tables: bool = False
    rejects: Callable[[Column], Column] | None = None


def _has(text: Column, *words: str) -> Column:
    found = F.lit(True)
    for word in words:
        found = found & F.contains(text, F.lit(word))
    return found


# Layout names and the marks that tell them apart, first rule wins.
def _is_divisione(text: Column, upper: Column) -> Column:
    return _has(upper, "DIVISIONE CUCINE") | _has(upper, "N. 300", "ORDINE FORNITORE")


def _is_bebitalia(text: Column, upper: Column) -> Column:
    return _has(upper, "B&B ITALIA", "ORDINE ACQUISTO")


def _is_oafa(text: Column, upper: Column) -> Column:
    return matches(text, r"A\s*\d{3,}") & _has(upper, "DECA") & _has(text, "Spett.le")


def _is_aza(text: Column, upper: Column) -> Column:
    return _has(upper, "ORDINE FORNITORE", "AZA INTERNATIONAL")


def _is_for_ordine(text: Column, upper: Column) -> Column:
    return _has(upper, "ORDINE FORNITORE")


def _is_ordine_ls(text: Column, upper: Column) -> Column:
    return _has(upper, "ABIEFFE") | (
        _has(upper, "ORDINE") & (_has(upper, "LS") | _has(upper, "L.S"))
    )


def _is_anything(text: Column, upper: Column) -> Column:
    return F.lit(True)


DEFAULT_LAYOUTS = (
    Layout("DIVISIONE", _is_divisione, divisione.header, divisione.items),
    Layout("PO_BEBITALIA", _is_bebitalia, bebitalia.header, bebitalia.items),
    Layout("OAFA", _is_oafa, oafa.header, oafa.items, min_items=5),
    Layout("FOR_ORDINE_AZA", _is_aza, aza.header, aza.items, reads_tables=False, rejects=aza.rejects),
    Layout("FOR_ORDINE", _is_for_ordine, for_ordine.header, for_ordine.items, rejects=for_ordine.rejects),
    Layout(
        "ORDINE_LS",
        _is_ordine_ls,
        ordine_ls.header,
        ordine_ls.items,
        reads_tables=False,
        client_from_tables=True,
    ),
    Layout("GENERIC", _is_anything, generic.header, generic.items, min_items=5),
)


def register_layout(
    layout: Layout, layouts: Sequence[Layout] = DEFAULT_LAYOUTS, before: str = "GENERIC"
) -> tuple[Layout, ...]:
    """The layouts with one more, tried just before the named one."""
    at = [known.name for known in layouts].index(before)
    return (*layouts[:at], layout, *layouts[at:])


def layout_name(
    text: Column, upper: Column, layouts: Sequence[Layout] = DEFAULT_LAYOUTS
) -> Column:
    chosen = F.lit(None).cast("string")
    for layout in reversed(layouts):
        chosen = F.when(layout.recognise(text, upper), layout.name).otherwise(chosen)
    return chosen


def classify_layout(
    docs: DataFrame, layouts: Sequence[Layout] = DEFAULT_LAYOUTS
) -> DataFrame:
    """Documents with a ``layout`` column; the upper-cased text is made once."""
    upper = docs.withColumn("_upper", F.upper("text"))
    return upper.withColumn(
        "layout", layout_name(F.col("text"), F.col("_upper"), layouts)
    ).drop("_upper")
