"""Literal samples of every layout: small texts with hand-checked results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderflow.operators import layout as L
from orderflow.operators.extraction import extract, items_as_rows
from orderflow.operators.extractors import oafa, ordine_ls
from orderflow.operators.mdtable import markdown_cells, markdown_items

DIVISIONE = """DIVISIONE CUCINE spa
Ordine N. 300 000 946 ORDINE FORNITORE
Data / Date 03/02/2026
Consegna richiesta / Delivery date
03/02/2026 03/04/26
305AVAR1380---- NR 500REGGIMENSOLA VERNICIATO GRIGIO
  12ABCDEFGHIJKL----- NR 7
"""

BEBITALIA = """B&B ITALIA SPA
ORDINE ACQUISTO 20250006705-3
DATA DOCUMENTO: 02/02/2026
S99976389 ASSEMBLAGGIO - TF SEDILE  INFER VER DIV2P DS217-203P DIE PZ 10,00 111,31 09/03/2026
S99976390 ASSEMBLAGGIO - TF SEDILE INFER VERN DIV 3P NR 10,50 1,00 10/03/2026
S99976389 ASSEMBLAGGIO again PZ 99,00
"""

AZA = """AZA INTERNATIONAL SRL via tale
ORDINE FORNITORE 57/AC del 30/01/2026
DATA CONSEGNA/DESPATCH:
 15/03/2026
NR 100,00 € 716,80 € 7,1680 SPORTELLO DOS. LINEARE 0582DOS1SN
NR 1.000,00 € 716,80 € 7,1680 SPORTELLO DOS. LINEARE 0582DOS1SN
NR 1,00 troppo corta
"""

FOR_ORDINE = """Officine Rossi S.r.l.
Via Roma 1
Spett.le
205
ORDINE FORNITORE del giorno
Data Doc. 21/01/2026
1,00 23,23 03/02/2026 PZ 05EYSPMP05 23,23 2 STAFFA  GRANDE
1,00 23,23 04/02/2026 PZ 05EYSPMP06 11,00 5 STAFFA PICCOLA
7 CF 002 - COLONNINA BASSA 1 FORO PZ200,00
8 CF 002 - ALTRA PZ1,00
9 CF 003 - PIASTRA PZ1,00
"""

LS_PRICED = """Ordine n. 172
Abieffe Trading S.r.l
Data di consegna: 10/04/2026
TFTAUT1 Telaio Ferro sedia TATTOO 1 MD031000 10 47.19
fine
"""

GENERIC = """# Ferramenta Bianchi
Order # 4711
Data consegna: 31/02/2026
Despatch: 05/05/2026
| Codice articolo | Descrizione | Quantità |
|---|---|---|
| TFT1 | telaio ferro | 2,50 |
| 20 | solo numero | 1 |
| MD03 | sedia alta | 7 pz |
| Totale | tutto | 99 |
| MD04 | dopo il piede | 7 |
"""

SAMPLES = {
    "DIVISIONE": DIVISIONE,
    "PO_BEBITALIA": BEBITALIA,
    "FOR_ORDINE_AZA": AZA,
    "FOR_ORDINE": FOR_ORDINE,
    "ORDINE_LS": LS_PRICED,
    "GENERIC": GENERIC,
}


def oafa_text(order="before"):
    rows = []
    for i, qty in enumerate(["2,00", "1,50", "3,00", "2,00", "1,00"]):
        code, job = f"25CCPA{i:04d}-00", "C25-365-3"
        name = [f"Carter {i} 1.0037", "(S235JR)"]
        if order == "before":
            rows += [code, job, *name, qty, "Nr", "18/02/26"]
        else:
            rows += [*name, qty, "Nr", "18/02/26", code, job]
    head = ["Documento", "Spett.le", "Ordine Fornitore", "A  000125", "30/01/2026",
            "Cliente Srl", "DECA S.r.l.", "C25-365"]
    return "\n".join(head + rows + ["Note", "Totale"])


@pytest.fixture(scope="module")
def result(spark):
    texts = dict(SAMPLES, OAFA=oafa_text(), EMPTY="")
    docs = spark.createDataFrame(
        [(k, f"/in/{k}_0000999.pdf", v) for k, v in texts.items()],
        "doc_id string, path string, text string",
    )
    return {r.doc_id: r for r in extract(docs).collect()}


def items(row):
    return [(i.code, i.name, i.qty) for i in row["items"]]


def test_layouts(result):
    for name in [*SAMPLES, "OAFA"]:
        assert result[name].layout == name
    assert result["EMPTY"].layout is None
    assert result["EMPTY"].error == "No text extracted from PDF"


def test_divisione(result):
    row = result["DIVISIONE"]
    assert items(row) == [
        ("05AVAR1380", "REGGIMENSOLA VERNICIATO GRIGIO", 500.0),
        ("ABCDEFGHIJKL", "ABCDEFGHIJKL", 7.0),
    ]
    assert (row.client, row.order_no) == ("DIVISIONE CUCINE", "300000946")
    assert (row.due, row.received) == (dt.date(2026, 4, 3), dt.date(2026, 2, 3))


def test_bebitalia(result):
    row = result["PO_BEBITALIA"]
    assert items(row) == [
        ("S99976389", "ASSEMBLAGGIO - TF SEDILE INFER VER DIV2P DS217-203P DIE", 10.0),
        ("S99976390", "ASSEMBLAGGIO - TF SEDILE INFER VERN DIV 3P", 10.0),
    ]
    assert row.total_quantity == 20.0
    assert (row.client, row.order_no) == ("B&B ITALIA S.p.A.", "20250006705-3")
    assert (row.due, row.received) == (dt.date(2026, 3, 9), dt.date(2026, 2, 2))


def test_aza(result):
    row = result["FOR_ORDINE_AZA"]
    assert items(row) == [("0582DOS1SN", "7,1680 SPORTELLO DOS. LINEARE", 100.0)]
    assert row.client == "AZA INTERNATIONAL SRL via tale"
    assert (row.order_no, row.due, row.received) == (
        "57", dt.date(2026, 3, 15), dt.date(2026, 1, 30))


def test_for_ordine(result):
    row = result["FOR_ORDINE"]
    assert items(row) == [
        ("05EYSPMP05", "STAFFA GRANDE", 2.0),
        ("05EYSPMP06", "STAFFA PICCOLA", 5.0),
        ("CF 002", "COLONNINA BASSA 1 FORO", 7.0),
        ("CF 003", "N/A", 9.0),
    ]
    assert (row.client, row.order_no) == ("Officine Rossi S.r.l.", "205")
    assert (row.due, row.received) == (dt.date(2026, 2, 3), dt.date(2026, 1, 21))


def test_for_ordine_variants(spark):
    near = "PZ ABCDEF01 PZ ABCDEF02 1,00 3 NOME\n"
    docs = spark.createDataFrame(
        [
            ("slash", "/x/FOR-ORDINE_0000205_00.pdf", "ORDINE FORNITORE /260100 21/01/2026\n" + near),
            ("veto", "/x/a.pdf", "L.S. SRL\nORDINE FORNITORE\n12 ORDINE FORNITORE\n"),
            ("glued", "/x/b.pdf", "AL. IVATecnoapp  S.r.l. Unipersonale 1\n ORDINE FORNITORE"),
        ],
        "doc_id string, path string, text string",
    )
    rows = {r.doc_id: r for r in extract(docs).collect()}
    assert rows["slash"].client == "Sozzi Arredamenti S.p.A."
    assert rows["slash"].order_no == "260100"
    # The second code starts within the gap, so both read the same segment.
    assert items(rows["slash"]) == [("ABCDEF01", "NOME", 3.0), ("ABCDEF02", "NOME", 3.0)]
    assert rows["veto"].client is None and rows["veto"].order_no == "12"
    assert rows["glued"].client == "AL. IVATecnoapp  S.r.l. Unipersonale 1"


def test_oafa(result, spark):
    row = result["OAFA"]
    names = [f"Carter {i} 1.0037 (S235JR)" for i in range(5)]
    assert [i.name for i in row["items"]] == names
    assert [i.qty for i in row["items"]] == [2.0, 1.5, 3.0, 2.0, 1.0]
    assert (row.client, row.order_no) == ("DECA S.r.l.", "A000125")
    assert row.received == dt.date(2026, 1, 30)
    docs = spark.createDataFrame([("a", oafa_text("after"))], "doc_id string, text string")
    pick = lambda p: docs.select(oafa.items(F.col("text"), p).alias("i")).first()["i"]
    assert [(x.code, x.name) for x in pick("after")] == [
        (f"25CCPA{i:04d}-00", n) for i, n in enumerate(names)
    ]
    # Reading such a print with codes first pairs each code with the next article.
    assert [(x.code, x.name) for x in pick("before")] == [
        (f"25CCPA{i:04d}-00", n) for i, n in enumerate(names[1:])
    ]


def test_ls_shapes(result, spark):
    row = result["ORDINE_LS"]
    assert items(row) == [("TFTAUT1", "Telaio Ferro sedia TATTOO 1", 10.0)]
    assert (row.client, row.order_no, row.due) == (
        "Abieffe Trading S.r.l", "172", dt.date(2026, 4, 10))
    texts = {
        "counted": "3LAMSO3546.01 SO35462 / 4 NR 2",
        "revised": "SR5-05530-004 Band. PR.600=300 PS5530 F 2",
        "named": "HG1103101 INTERF ACCIA SISTEMA\nHG1103102 ALTRO NOME",
        "two": "ABCD12345 SO-354 NR 4\nLAMERA INOX (a disegno)",
        "none": "niente da vedere",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {
        r.doc_id: [tuple(i) for i in r.i]
        for r in docs.select("doc_id", ordine_ls.items(F.col("text")).alias("i")).collect()
    }
    assert got == {
        "counted": [("3LAMSO3546.01", "3LAMSO3546.01", 2.0)],
        "revised": [("SR5-05530-004", "Band. PR.600=300", 2.0)],
        "named": [
            ("HG1103101", "INTERF ACCIA SISTEMA", 1.0), ("HG1103102", "ALTRO NOME", 1.0)],
        "two": [("ABCD12345", "LAMERA INOX", 4.0)],
        "none": [],
    }


def test_generic(result):
    row = result["GENERIC"]
    assert items(row) == [("TFT1", "telaio ferro", 2.0), ("MD03", "sedia alta", 7.0)]
    assert (row.client, row.order_no, row.due) == (
        "Ferramenta Bianchi", "4711", dt.date(2026, 5, 5))
    assert row.needs_tables


def test_generic_without_header(spark):
    docs = spark.createDataFrame(
        [
            ("pattern", "riga unica\n|AB12 | staffa lunga | x | 2,5 |\n"),
            ("client", "# OR\nLS Srl - sede\nVia Roma\nBianchi Metalli - Lecco\n"),
            ("greet", "ciao a tutti\nCordiali saluti Rossi Mario\n"),
        ],
        "doc_id string, text string",
    )
    rows = {r.doc_id: r for r in extract(docs, path=None).collect()}
    assert items(rows["pattern"]) == [("AB12", "staffa lunga", 2.5)]
    assert rows["client"].client == "Bianchi Metalli"
    assert rows["greet"].client == "Rossi Mario"


MARKDOWN = """testo
| CODICE | DESCRIZIONE | QUANTITA |
|--------|-------------|----------|
| 25AA01 | Test Part 1 | 2,50 |
| 25BB02 | Test Part 2 | 1,00 |
| codice | x | 1 |
| 25CC03 | Totale netto | 1 |
| 25CC04 | ok | tanti |
| 25CC05 | aperta | 1

| CODE | QTY |
|---|---|

| ARTICOLO | NR |
|---|---|
| A1 | 1 000 |
"""


def test_markdown(spark):
    docs = spark.createDataFrame([("m", MARKDOWN)], "doc_id string, text string")
    got = [tuple(r)[2:] for r in markdown_items(docs).orderBy("pos").collect()]
    assert got == [
        ("25AA01", "Test Part 1", "2,50", 2.5),
        ("25BB02", "Test Part 2", "1,00", 1.0),
        ("A1", "A1", "1 000", 1000.0),
    ]
    cells = markdown_cells(docs)
    assert cells.where("table_no = 0 and row_no = 2").orderBy("col_no").first().cell == "25AA01"
    assert cells.agg(F.max("table_no")).first()[0] == 1


def test_table_text_is_a_fallback(spark):
    docs = spark.createDataFrame(
        [("a", "DIVISIONE CUCINE", MARKDOWN), ("b", DIVISIONE, MARKDOWN), ("c", AZA[:80], MARKDOWN)],
        "doc_id string, text string, tables string",
    )
    rows = {r.doc_id: r for r in extract(docs, path=None, table_text="tables").collect()}
    assert [i.code for i in rows["a"]["items"]] == ["25AA01", "25BB02", "A1"]
    assert [i.code for i in rows["b"]["items"]] == ["05AVAR1380", "ABCDEFGHIJKL"]
    assert rows["c"]["items"] == []


def test_company_from_table_text(spark):
    converted = "Via Roma S.p.A.\nsrl\nBianchi Metalli S.r.l.\nVerdi SpA"
    docs = spark.createDataFrame(
        [("a", "ordine LS n. 1", converted), ("b", "nota", converted), ("c", "ordine LS", None)],
        "doc_id string, text string, tables string",
    )
    rows = {r.doc_id: r for r in extract(docs, path=None, table_text="tables").collect()}
    assert rows["a"].client == "Bianchi Metalli S.r.l."
    assert rows["b"].client is None and rows["c"].client is None


def test_registered_layout(spark):
    own = L.Layout(
        "OWN",
        lambda text, upper: F.contains(upper, F.lit("OWN ORDER")),
        lambda text, path: {
            "client": F.lit("me"),
            "order_no": F.regexp_extract(text, r"no (\d+)", 1),
            "due": F.lit(None).cast("date"),
            "received": F.lit(None).cast("date"),
        },
        lambda text: F.array(
            F.struct(F.lit("c").alias("code"), F.lit("").alias("name"), F.lit(1.0).alias("qty"))
        ),
    )
    docs = spark.createDataFrame(
        [("a", "own order no 7 ls"), ("b", "nothing")], "doc_id string, text string"
    )
    rows = {
        r.doc_id: r for r in extract(docs, L.register_layout(own, before="DIVISIONE"), path=None).collect()
    }
    assert (rows["a"].layout, rows["a"].order_no) == ("OWN", "7")
    assert items(rows["a"]) == [("c", "c", 1.0)]
    assert rows["b"].layout == "GENERIC"


def test_items_as_rows_keep_position(spark, result):
    docs = spark.createDataFrame([("d", DIVISIONE)], "doc_id string, text string")
    rows = items_as_rows(extract(docs, path=None)).orderBy("pos").collect()
    assert [(r.pos, r.code) for r in rows] == [(0, "05AVAR1380"), (1, "ABCDEFGHIJKL")]


def test_extraction_needs_no_shuffle(spark):
    docs = spark.createDataFrame([("d", DIVISIONE)], "doc_id string, text string")
    plan = extract(docs, path=None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_item_rejects(spark):
    """Accepted and refused items are together what was found; each refusal has a reason."""
    text = (
        "Metalli Uniti S.r.l.\nORDINE FORNITORE\n"
        "1,00 23,23 01/02/2026 PZ CF1111 23,23 0 NIENTE\n"
        "1,00 23,23 01/02/2026 PZ CF2222 23,23 7 STAFFA\n"
        "1,00 23,23 01/02/2026 PZ CF3333 23,23 4 DESCRIZIONE LUNGA\n"
    )
    aza = "AZA INTERNATIONAL\nORDINE FORNITORE 1/AC del 01/01/2026\nNR 0,00 € 716,80 € 7,16 SPORTELLO ZA00000001\nNR 5,00 € 716,80 € 7,16 PIANO ZA00000002\n"
    docs = spark.createDataFrame([("a", "a", text), ("b", "b", aza), ("c", "c", None)], "doc_id string, path string, text string")
    from orderflow.operators.extraction import extract_items, item_rejects

    refused = {(r.doc_id, r.code): r.reason for r in item_rejects(docs).collect()}
    assert refused == {("a", "CF1111"): "quantity", ("a", "CF3333"): "heading", ("b", "ZA00000001"): "quantity"}
    kept = {(r.doc_id, r.code) for r in extract_items(docs).collect()}
    assert kept == {("a", "CF2222"), ("b", "ZA00000002")}


def test_only_named_header_fields(spark):
    """Header fields that nobody wants are not looked for; the others stay as they are."""
    text = "AZA INTERNATIONAL S.R.L.\nORDINE FORNITORE 77/AC del 01/02/2024\nDATA CONSEGNA: 03/04/2024"
    docs = spark.createDataFrame([("1", "/a.pdf", text), ("2", "/b.pdf", "")], "doc_id string, path string, text string")
    whole = extract(docs)
    for fields in (("order_no",), ("due", "client"), ()):
        found = extract(docs, headers=fields)
        assert {"client", "order_no", "due", "received"} & set(found.columns) == set(fields)
        assert ("due_missing" in found.columns) == ("due" in fields)
        assert sorted(found.collect(), key=str) == sorted(whole.select(found.columns).collect(), key=str)
