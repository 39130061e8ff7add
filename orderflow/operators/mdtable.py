"""Pipe tables inside document text: tables, cells, column roles, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.numbers import decimal_comma
from orderflow.functions.text import let, matches, strip
from orderflow.operators.lines import islands, stripped_lines

# Header names per column role, and words that mark rows which
# are no articles.
CODE_HEADERS = r"^(CODICE|CODE|ARTICOLO|PRODUCT\s*CODE|ART\.?|REF|REFERENCE|SKU|PART\s*NUMBER)$"
NAME_HEADERS = r"^(DESCRIZIONE|DESCRIPTION|DESC|ARTICOLO|ARTICLE|PRODUCT|DENOMINAZIONE)$"
QTY_HEADERS = (
    r"^(QUANTITA|QTY|QTA|CANTIDAD|QUANTITY|MENGE|QUANTITÉ|QTESS?|AMOUNT|NUMERO|NR|NUM)$"
)
HEADER_WORDS = ["CODICE", "CODE", "DESCRIZIONE", "QUANTITA", "QTY", "ARTICOLO"]
FOOTER_WORDS = [
    "NOTE", "TRASPORTO", "SPESE", "TOTALE", "SCONTO", "ASSICUR", "BANCARIE", "EVENTUALI",
]
MIN_TABLE_LINES = 3


def tables(text: Column) -> Column:
    """``array<array<array<string>>>``: tables, rows, trimmed cells.

    A table is a run of at least three lines that start with a pipe; of those,
    lines that do not also end with one are dropped.
    """
    runs = islands(
        stripped_lines(text), lambda x: F.startswith(x, F.lit("|")), MIN_TABLE_LINES
    )
    cells = lambda row: F.transform(
        F.split(F.substring(row, F.lit(2), F.length(row) - 2), r"\|", -1), strip
    )
    return F.transform(
        runs,
        lambda run: F.transform(
            F.filter(run, lambda row: F.endswith(row, F.lit("|"))), cells
        ),
    )


def _role(headers: Column, pattern: str) -> Column:
    """1-based column of the first header that fits, 0 if none."""
    return F.array_position(
        F.transform(headers, lambda h: matches(F.upper(h), pattern)), True
    )


def _words(text: Column, words: list[str]) -> Column:
    return matches(text, "|".join(words), "i")


def _row_item(row: Column, code_at: Column, name_at: Column, qty_at: Column) -> Column:
    cell = lambda at: F.coalesce(F.get(row, (at - 1).cast("int")), F.lit(""))
    fits = F.greatest(code_at, name_at, qty_at) <= F.size(row)
    item = F.struct(
        cell(code_at).alias("code"),
        F.when(name_at > 0, cell(name_at)).otherwise(F.lit("")).alias("name"),
        cell(qty_at).alias("qty_raw"),
    )
    return F.when(fits, item)


def _valid(item: Column) -> Column:
    code, name = item["code"], item["name"]
    return (
        matches(code, "[A-Z0-9]")
        & ~_words(code, HEADER_WORDS)
        & ~_words(name, FOOTER_WORDS)
        & item["qty"].isNotNull()
    )


def _with_quantity(item: Column) -> Column:
    digits = F.replace(item["qty_raw"], F.lit(" "), F.lit(""))
    numeric = F.when(matches(digits, r"^\d+([.,]\d+)?$"), decimal_comma(digits))
    return F.struct(
        item["code"].alias("code"),
        item["name"].alias("name"),
        item["qty_raw"].alias("qty_raw"),
        numeric.alias("qty"),
    )


def _table_items(table: Column) -> Column:
    headers = F.coalesce(F.get(table, F.lit(0)), F.array().cast("array<string>"))
    roles = let(
        headers,
        lambda h: F.struct(
            _role(h, CODE_HEADERS).alias("code"),
            _role(h, NAME_HEADERS).alias("name"),
            _role(h, QTY_HEADERS).alias("qty"),
        ),
    )
    # Row 0 is the header and row 1 the separator.
    data = F.slice(table, F.lit(3), F.greatest(F.size(table), F.lit(0)))
    return let(
        roles,
        lambda r: F.filter(
            F.transform(
                F.array_compact(
                    F.transform(
                        F.filter(data, lambda _: (r["code"] > 0) & (r["qty"] > 0)),
                        lambda row: _row_item(row, r["code"], r["name"], r["qty"]),
                    )
                ),
                _with_quantity,
            ),
            _valid,
        ),
    )


def table_items(text: Column) -> Column:
    """Items of all tables: ``array<struct<code, name, qty_raw, qty>>``."""
    return F.flatten(F.transform(tables(text), _table_items))


def markdown_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cells as rows: (doc_id, table_no, row_no, col_no, cell)."""
    return (
        docs.select("doc_id", F.posexplode(tables(F.col(text))).alias("table_no", "rows"))
        .select("doc_id", "table_no", F.posexplode("rows").alias("row_no", "cells"))
        .select("doc_id", "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"))
    )


def markdown_items(docs: DataFrame, text: str = "text") -> DataFrame:
    """Items as rows, with the quantity both as text and as a number."""
    return docs.select(
        "doc_id", F.posexplode(table_items(F.col(text))).alias("pos", "item")
    ).select("doc_id", "pos", "item.*")
