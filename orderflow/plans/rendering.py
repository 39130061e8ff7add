"""Order documents rendered from the work-order tables.

No order documents come with the tables, so each layout has a print form here:
texts rendered from known articles are extracted again and compared with the
articles. An order is one document, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.sources import workorders as W

LAYOUTS = [
    "DIVISIONE", "PO_BEBITALIA", "FOR_ORDINE_AZA", "FOR_ORDINE", "OAFA", "ORDINE_LS",
    "GENERIC",
]
BROKEN = len(LAYOUTS)


@dataclass(frozen=True)
class Print:
    """Head, article line and foot of a layout as column expressions."""

    head: Callable[[], Column]
    line: Callable[[], Column]
    foot: str | None = None


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _day(name: str, pattern: str = "dd/MM/yyyy") -> Column:
    return F.date_format(name, pattern)


def _digits(value: Column, width: int) -> Column:
    """Zero-padded number, never cut."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def _order(width: int = 1) -> Column:
    return _digits(F.col("order_id"), width)


def _part(width: int = 8) -> Column:
    return _digits(F.col("part_key"), width)


def _qty() -> Column:
    return F.col("qty").cast("long").cast("string")


def _upper() -> Column:
    return F.upper("name")


def _number() -> Column:
    return (F.col("idx") + 1).cast("string")


def _divisione_head() -> Column:
    n = F.lpad((F.col("order_id") % 1_000_000).cast("string"), 6, "0")
    return _text(
        "DIVISIONE CUCINE\nORDINE N. 300 ", F.substring(n, 1, 3), " ", F.substring(n, 4, 3),
        "\nData / Date ", _day("received"),
        "\nConsegna richiesta / Delivery date\n", _day("received"), " ", _day("due"),
    )


def _divisione_line() -> Column:
    return _text(_number(), "AVAR", _part(10), "----  NR ", _qty(), _upper())


def _bebitalia_head() -> Column:
    return _text(
        "B&B ITALIA S.p.A.\nORDINE ACQUISTO ", _order(11), "-1\nDATA DOCUMENTO ",
        _day("received"),
    )


def _bebitalia_line() -> Column:
    unit = F.when(F.col("idx") % 2 == 0, " PZ ").otherwise(" NR ")
    return _text("S", _part(8), " ", _upper(), unit, _qty(), ",50 1,00 ", _day("due"))


def _aza_head() -> Column:
    return _text(
        "AZA INTERNATIONAL S.R.L.\nORDINE FORNITORE ", _order(), "/AC del ",
        _day("received"), "\nDATA CONSEGNA: ", _day("due"),
    )


def _aza_line() -> Column:
    return _text("NR ", _qty(), ",00 € 716,80 € 7,16 ", _upper(), " ZA", _part())


def _for_ordine_head() -> Column:
    return _text(
        "Metalli Uniti S.r.l.\nVIA Roma 1\nSpett.le\n", _order(),
        "\nORDINE FORNITORE\nData Doc. ", _day("received"),
    )


def _for_ordine_line() -> Column:
    after = _text("1,00 23,23 ", _day("due"), " PZ CF", _part(), " 23,23 ", _qty(), " ", _upper())
    before = _text(_number(), " CF", _part(), " - ", F.col("name"), " PZ200,00")
    return F.when(F.col("idx") % 2 == 0, after).otherwise(before)


def _oafa_head() -> Column:
    return _text(
        "Documento\nSpett.le\nOrdine Fornitore\nA  ", _order(10), "\n", _day("received"),
        "\nDECA S.r.l.",
    )


def _oafa_line() -> Column:
    return _text(
        "25CC", _part(), "\nC25-365-3\n", _upper(), " S235JR\n", _qty(), ",00\n", _day("due", "dd/MM/yy"), "\nNr",
    )


def _ls_head() -> Column:
    return _text(
        "Data ", _day("received"), "\nOrdine n. ", _order(),
        "\nAbieffe Trading S.r.l\nConsegna: ", _day("due"), "\ndel 1 gennaio 2000",
    )


def _ls_line() -> Column:
    shape = F.col("order_id") % 4
    return (
        F.when(
            shape == 0,
            _text("TF", _part(), " ", F.col("name"), " MD031000 ", _qty(), " 47.19 C"),
        )
        .when(shape == 1, _text("3LAM.", _part(), " SO35462 / 4 NR ", _qty()))
        .when(shape == 2, _text("SR5-", _part(), " ", F.col("name"), " PS5530 F ", _qty()))
        .otherwise(_text("HG", _part(), " ", _upper(), " *"))
    )


def _generic_head() -> Column:
    return _text(
        "Ferramenta Bianchi snc\nOrder # ", _order(), "\nDespatch: ", _day("due"),
        "\n| Codice articolo | Descrizione | Quantità |\n|---|---|---|",
    )


def _generic_line() -> Column:
    return _text("| GX", _part(), " | ", F.col("name"), " | ", _qty(), " |")


PRINTS = {
    "DIVISIONE": Print(_divisione_head, _divisione_line),
    "PO_BEBITALIA": Print(_bebitalia_head, _bebitalia_line),
    "FOR_ORDINE_AZA": Print(_aza_head, _aza_line),
    "FOR_ORDINE": Print(_for_ordine_head, _for_ordine_line),
    "OAFA": Print(_oafa_head, _oafa_line),
    "ORDINE_LS": Print(_ls_head, _ls_line, "fine"),
    "GENERIC": Print(_generic_head, _generic_line, "| Totale | - | 99 |"),
}

TABLE_PRINT = Print(
    lambda: _text(
        "Conferma ", _order(), "\n| CODICE | DESCRIZIONE | QUANTITA |\n|---|---|---|"
    ),
    lambda: _text("| MT", _part(), " | ", F.col("name"), " | ", _qty(), ",50 |"),
    "| T0 | Totale | 1 |\nfine",
)


def _documents(
    spark: SparkSession, folder: str, head: Column, line: Column, foot: Column, kind: Column
) -> DataFrame:
    articles = W.work_articles(spark, folder, names=True).drop("required_phases")
    orders = W.work_orders(spark, folder, client=False).select("order_id", "received", "due")
    # The numbering left articles partitioned by order; the join and the
    # grouping both reuse that, so only the orders move.
    return (
        orders.join(articles, "order_id", "left")
        .select(
            "order_id",
            "received",
            "due",
            F.when(
                F.col("idx").isNotNull(), F.struct(F.col("idx"), line.alias("line"))
            ).alias("entry"),
        )
        .groupBy("order_id", "received", "due")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .withColumn(
            "body",
            F.when(
                F.size("entries") > 0,
                F.array_join(F.transform("entries", lambda x: x["line"]), "\n"),
            ),
        )
        .select(
            _order().alias("doc_id"),
            _text("/orders/", kind, "_", _order(7), ".pdf").alias("path"),
            F.concat_ws("\n", head, "body", foot).alias("text"),
        )
    )


def render(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """All orders in one layout: (doc_id, path, text)."""
    p = TABLE_PRINT if layout == "TABLE" else PRINTS[layout]
    return _documents(
        spark, folder, p.head(), p.line(), F.lit(p.foot).cast("string"), F.lit(layout)
    )


def layout_of_order() -> Column:
    return F.col("order_id") % (BROKEN + 1)


def render_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """All orders, layouts taking turns; every eighth document is broken:
    empty, or a note without any order data."""
    turn = layout_of_order()

    def choose(pick) -> Column:
        chosen = F.lit(None).cast("string")
        for i, name in enumerate(LAYOUTS):
            chosen = F.when(turn == i, pick(name)).otherwise(chosen)
        return chosen

    docs = _documents(
        spark,
        folder,
        choose(lambda n: PRINTS[n].head()),
        choose(lambda n: PRINTS[n].line()),
        choose(lambda n: F.lit(PRINTS[n].foot)),
        F.coalesce(choose(F.lit), F.lit("NOTE")),
    )
    order = F.col("doc_id").cast("long")
    broken = F.when(order % (2 * BROKEN + 2) == BROKEN, F.lit("")).otherwise(
        F.lit("appunto\nsenza dati")
    )
    return docs.withColumn(
        "text", F.when(order % (BROKEN + 1) == BROKEN, broken).otherwise(F.col("text"))
    )
