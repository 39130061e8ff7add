"""Any other order: headings, labels, and pipe-separated item rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import LONG_YEAR_DATE, day_month_year
from orderflow.functions.numbers import decimal_comma, whole
from orderflow.functions.text import (
    all_matches,
    contains_any,
    first_match,
    first_of,
    let,
    matches,
    strip,
)
from orderflow.operators.extractors.common import item, no_items
from orderflow.operators.lines import first_line, indexes_where, stripped_lines, until

# Labels, word lists and shapes of this layout.
HEADING = r"^#+\s+([A-Za-z0-9\s\.]+?)(?:\s+-|\n)"
GREETING = r"Cordiali\s+saluti\s+([A-Za-z0-9\s\.]+?)(?:\n|$)"
DELIVERED_AT = r"Consegna\s+presso\s+([A-Za-z0-9\s\.]+?)(?:\n|$)"
ADDRESSED_TO = r"Spettabile\s+([A-Za-z0-9\s\.]+?)(?:\n|$|VIA|Via|via)"
RECIPIENT = "LS"
COMPANY_WORDS = ["S.R.L", "SRL", "S.P.A", "SPA", "S.A.S", "SAS"]
HEADER_WORDS = [
    "ORDINE", "DATA", "TELEFONO", "FAX", "NOTE", "CONSEGNA", "VIA", "CIVATE", "PAGINA",
    "DESPATCH",
]
RULE_LINE = r"^[\s#|-]*$"
NUMBERS = [
    r"(?:##\s*)?ORDINE\s+FORNITORE\s*\n?\s*(\d+/[A-Z]+)",
    r"(\d+/[A-Z]+)\s*n\.?",
    r"[Oo]rdine\s+[\w\.]*\s*(\d+/[A-Z]+)",
    r"[Oo]rdine\s+(?:n\.?|n°|#)\s*(\d+)",
    r"[Oo]rder\s*#\s*(\d+)",
    r"[Ff]ornitore\s+(\d+/[A-Z]+)",
    r"[Oo]rdine\s+[\d\s]*(\d{3,})",
]
DUE_LABELS = [
    r"data\s+(?:di\s+)?consegna.*?despatch",
    r"despatch",
    r"data\s+di\s+consegna",
    r"data\s+consegna",
]
TABLE_HEADER_WORDS, TABLE_HEADER_LOWER = ["Codice", "Quantità"], "articolo"
TABLE_ROWS_FROM = 2
BLANK_ROW = r"^[\s\-|=]*$"
FOOTER_WORDS = ["SOMMA", "TOTALE", "IVA", "PAGAMENTO", "CONSEGNA", "CORDIALI"]
PIPE_ITEM = r"\|([A-Z0-9]{2,})\s*\|\s*([A-Za-z\s]+?)\s*\|.*?(\d+(?:[.,]\d+)?)\s*\|"
MIN_FIELDS, MIN_NAME = 3, 4


def _labelled(text: Column, pattern: str, flags: str, accept) -> Column:
    """Name behind a label, unless it is not acceptable."""
    name = strip(first_match(text, pattern, 1, flags))
    return let(name, lambda n: F.when(accept(n), n))


def _not_recipient(name: Column) -> Column:
    return ~F.contains(F.upper(name), F.lit(RECIPIENT))


def _free_line(text: Column) -> Column:
    """First line that names a company or at least two ordinary words."""

    def candidate(line: Column) -> Column:
        def judge(upper: Column, cut: Column) -> Column:
            words = (
                (F.length(line) > 5)
                & ~contains_any(upper, HEADER_WORDS)
                & matches(line, r"\S\s+\S")
            )
            usable = (F.length(cut) > 3) & ~F.startswith(F.upper(cut), F.lit(RECIPIENT))
            fits = usable & (contains_any(upper, COMPANY_WORDS) | words)
            return F.when(fits & ~matches(line, RULE_LINE), cut)

        before_bar = strip(F.regexp_extract(line, r"^[^|-]*", 0))
        return let(F.upper(line), lambda u: let(before_bar, lambda cut: judge(u, cut)))

    return first_of(F.array_compact(F.transform(stripped_lines(text), candidate)))


def _client(text: Column) -> Column:
    return F.coalesce(
        _labelled(
            text,
            HEADING,
            "m",
            lambda n: (F.length(n) > 3) & ~F.contains(F.upper(n), F.lit("ORDINE")),
        ),
        _labelled(text, GREETING, "i", _not_recipient),
        _labelled(text, DELIVERED_AT, "i", _not_recipient),
        _labelled(
            text, ADDRESSED_TO, "i", lambda n: ~F.startswith(F.upper(n), F.lit(RECIPIENT))
        ),
        _free_line(text),
    )


def header(text: Column, path: Column) -> dict[str, Column]:
    due = [
        day_month_year(first_match(text, rf"{label}\s*:?\s*({LONG_YEAR_DATE})", 1, "is"))
        for label in DUE_LABELS
    ]
    return {
        "client": _client(text),
        "order_no": F.coalesce(*[first_match(text, p, 1, "ms") for p in NUMBERS]),
        "due": F.coalesce(*due),
        "received": F.lit(None).cast("date"),
    }


def _field_quantity(field: Column) -> Column:
    """A whole number if the field holds one, else a decimal."""
    return F.coalesce(
        whole(first_match(field, r"\b(\d+)\b")),
        decimal_comma(first_match(field, r"(\d+[.,]\d+)")),
    )


def _row_item(row: Column) -> Column:
    fields = F.filter(F.transform(F.split(row, r"\|", -1), strip), lambda f: f != "")
    return let(
        fields,
        lambda fs: F.when(
            F.size(fs) >= MIN_FIELDS,
            item(
                F.get(fs, F.lit(0)),
                F.get(fs, F.lit(1)),
                first_of(
                    F.array_compact(
                        F.transform(F.slice(fs, F.lit(3), F.size(fs)), _field_quantity)
                    )
                ),
            ),
        ),
    )


def _table_items(lines: Column, header_at: Column) -> Column:
    rows = F.filter(
        F.slice(lines, header_at + TABLE_ROWS_FROM + 1, F.size(lines)),
        lambda x: ~matches(x, BLANK_ROW),
    )
    body = until(rows, lambda x: contains_any(F.upper(x), FOOTER_WORDS))
    return F.filter(
        F.array_compact(F.transform(body, _row_item)),
        lambda x: (x["qty"] > 0)
        & (F.length(x["name"]) >= MIN_NAME)
        & ~matches(x["code"], r"^[\d.,]*\d[\d.,]*$"),
    )


def _pattern_items(text: Column) -> Column:
    found = F.transform(
        all_matches(text, PIPE_ITEM),
        lambda x: item(
            first_match(x, PIPE_ITEM, 1),
            strip(first_match(x, PIPE_ITEM, 2)),
            decimal_comma(first_match(x, PIPE_ITEM, 3)),
        ),
    )
    return F.filter(found, lambda x: (x["qty"] > 0) & (F.length(x["name"]) >= MIN_NAME))


def items(text: Column) -> Column:
    """Rows under an item-table heading; a pipe pattern where there is none."""

    def is_header(line: Column) -> Column:
        return contains_any(line, TABLE_HEADER_WORDS) & F.contains(
            F.lower(line), F.lit(TABLE_HEADER_LOWER)
        )

    def read(lines: Column) -> Column:
        return let(
            first_of(indexes_where(lines, is_header)),
            lambda at: F.when(at.isNotNull(), _table_items(lines, at)),
        )

    return F.coalesce(let(stripped_lines(text), read), _pattern_items(text), no_items())
