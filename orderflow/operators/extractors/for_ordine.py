"""Supplier orders with two item shapes: code after the unit, or before a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.dates import SLASH_DATE, day_month_year
from orderflow.functions.numbers import whole
from orderflow.functions.text import (
    all_matches,
    contains_any,
    filled,
    first_match,
    let,
    lines_of,
    matches,
    rx,
    squeeze,
    strip,
)
from orderflow.operators.extractors.common import (
    HEADING,
    SHORT_CODE,
    accepted,
    first_per_code,
    item,
    known_client,
    no_heading,
    no_quantity,
    refused,
)
from orderflow.operators.lines import first_line, first_neighbour, stripped_lines, text_before

# Known clients by path, header words and shapes of this layout.
KNOWN_CLIENTS = [
    ("0000173", "Sozzi Arredamenti S.p.A."),
    ("0000205", "Sozzi Arredamenti S.p.A."),
    ("0000445", "Sozzi Arredamenti S.p.A."),
    ("0000537", "Sozzi Arredamenti S.p.A."),
]
HEADER_ENDS = ["Spett", "ORDINE"]
CONTACT_LINE = r"^(VIA|TEL|FAX|EMAIL|MAIL|HTTP|WWW|IBAN|BIC|REG|RAE|CAP|PAGINA|P\.|I\.V)"
TABLE_LINE = r"^(NR\.|CODICE|IMPORTO|NUMERO|DATA|PZ|QUANTITA|VOSTRO|VOSTRI|CONDIZIONI)"
COMPANY_WORDS = [
    "S.R.L", "SRL", "S.P.A", "SPA", "TRADING", "TECNOAPP", "OFFICINE", "INC", "LLC",
    "LTD", "&", "UNIPERSONALE", "TECNOAP",
]
COMPANY_NAMES = ["TECNOAPP", "OFFICINE", "ABIEFFE", "DECA", "TRADING", "SOZZI"]
COMPANY_TAIL = r"\s*(?:S\.?R\.?L\.?|S\.?P\.?A\.?)?\s*(?:UNIPERSONALE)?"
NAME_CONTEXT = 80
NOT_A_CLIENT = ["DESTINAZIONE", "CORRISPONDENZA", "L.S. SRL", "LS SRL", "L.S.", "LS."]
MARK = "ORDINE FORNITORE"
DUE = rf"\d+[.,]\d+\s+[\d.,]+\s+{SLASH_DATE}\s+PZ"
RECEIVED = rf"Data Doc.*?{SLASH_DATE}"
CODE_AFTER_UNIT = r"PZ\s+([\w\-]{6,})"
QTY_AND_NAME = r"\d+[.,]\d+\s+(\d+)\s+([A-Z][^\n]*)"
# The search for the next code starts this many characters after a code.
GAP = 10
CODE_BEFORE_DASH = r"^\s*\d+\s+([\w\s\-]{3,20}?)\s*-"
NAME_BEFORE_UNIT = r"-\s*([^P]+)(?:\s+PZ|$)"

# A code with the text up to the next one, in a look-ahead so that codes closer
# than the gap are still found on their own.
SEGMENT = (
    CODE_AFTER_UNIT
    + rf"(?=((?s:.{{{GAP}}}.*?(?=PZ\s+[\w\-]{{6,}}|\z)|.{{0,{GAP - 1}}}\z)))"
)


def _company_line(head: Column) -> Column:
    def company(line: Column) -> Column:
        return let(
            F.upper(line),
            lambda upper: F.length(line).between(4, 100)
            & contains_any(upper, COMPANY_WORDS)
            & ~matches(upper, CONTACT_LINE)
            & ~matches(upper, TABLE_LINE),
        )

    return first_line(stripped_lines(head), company)


def _company_name(head: Column, name: str) -> Column:
    """A known name with its legal form, read from the text right behind it."""
    near = F.regexp_extract(head, rx(f"{name}.{{0,{NAME_CONTEXT - len(name)}}}", "is"), 0)
    return filled(squeeze(F.regexp_extract(near, rx(name + COMPANY_TAIL, "i"), 0)))


def _client(text: Column, path: Column) -> Column:
    found = let(
        text_before(text, HEADER_ENDS),
        lambda head: F.coalesce(
            _company_line(head), *[_company_name(head, n) for n in COMPANY_NAMES]
        ),
    )
    accepted = let(found, lambda c: F.when(~contains_any(F.upper(c), NOT_A_CLIENT), c))
    return F.coalesce(known_client(path, KNOWN_CLIENTS), accepted)


def _number(text: Column) -> Column:
    def pick(previous: Column, line: Column, following: Column) -> Column:
        above = let(strip(previous), lambda p: F.when(matches(p, r"^\d+$"), p))
        return F.when(
            F.contains(line, F.lit(MARK)), F.coalesce(first_match(line, r"/(\d+)"), above)
        )

    return F.coalesce(
        first_neighbour(lines_of(text), pick),
        first_match(text, rf"^\s*(\d+)\s*{MARK}", 1, "m"),
    )


def header(text: Column, path: Column) -> dict[str, Column]:
    received = F.coalesce(first_match(text, RECEIVED, 1, "i"), first_match(text, SLASH_DATE))
    return {
        "client": _client(text, path),
        "order_no": _number(text),
        "due": day_month_year(first_match(text, DUE)),
        "received": day_month_year(received),
    }


def _why_not(x: Column) -> Column:
    return F.coalesce(
        no_quantity(x), F.when(F.length(x["code"]) < 2, SHORT_CODE), F.when(~no_heading(x["name"]), HEADING)
    )


def found_after_unit(text: Column) -> Column:
    return F.zip_with(
        all_matches(text, SEGMENT, 1),
        all_matches(text, SEGMENT, 2),
        lambda code, rest: item(
            code,
            squeeze(first_match(rest, QTY_AND_NAME, 2)),
            whole(first_match(rest, QTY_AND_NAME, 1)),
        ),
    )


def found_before_dash(text: Column) -> Column:
    """Here the quantity is the number that opens the line: its position."""
    return F.transform(
        all_matches(text, CODE_BEFORE_DASH + r"[^\n]*", 0, "m"),
        lambda x: item(
            strip(first_match(x, CODE_BEFORE_DASH)),
            F.coalesce(
                filled(squeeze(first_match(x, NAME_BEFORE_UNIT))), F.lit("N/A")
            ),
            whole(first_match(x, r"^\s*(\d+)\s+")),
        ),
    )


def items(text: Column) -> Column:
    return first_per_code(
        accepted(found_after_unit(text), _why_not), accepted(found_before_dash(text), _why_not)
    )


def rejects(text: Column) -> Column:
    """Articles found in either shape that are none, with the reason."""
    return F.concat(refused(found_after_unit(text), _why_not), refused(found_before_dash(text), _why_not))
