"""Corpora, sinks, ingest rules, reconciliation and small functions."""

import datetime as dt
import json

from pyspark.sql import functions as F

from orderflow.functions import dates, numbers, text
from orderflow.operators import ingest as I
from orderflow.operators import lines as N
from orderflow.operators import orders as O
from orderflow.operators import quality as Y
from orderflow.operators import reports as R
from orderflow.operators.extraction import extract, extract_headers, extract_items
from orderflow.operators.extractors.common import first_per_code, known_client
from orderflow.sources import corpus as C

ORDER_TEXT = "DIVISIONE CUCINE\nORDINE N. 300 000 946\n1AVAR0000000012---- NR 5SMALL\n"


def test_read_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_text(ORDER_TEXT)
    (tmp_path / "a.txt").write_text("niente")
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "sub" / "d.txt").write_text("")
    docs = C.read_corpus(spark, str(tmp_path))
    assert sorted(r.doc_id.rpartition("/")[2] for r in docs.collect()) == ["a.txt", "b.TXT"]
    deep = C.read_corpus(spark, str(tmp_path), recursive=True)
    assert {r.doc_id.rpartition("/")[2]: r.text for r in deep.collect()}["b.TXT"] == ORDER_TEXT
    assert Y.first_documents(docs, 1).first().doc_id.endswith("/a.txt")


def test_equal_names_are_two_documents(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.txt").write_text(ORDER_TEXT)
    found = extract(C.read_corpus(spark, str(tmp_path), recursive=True))
    assert I.orders_from_documents(found).select("order_id").distinct().count() == 2


def test_assemble_pages(spark):
    pages = spark.createDataFrame(
        [("d", 2, "tre"), ("d", 0, "uno"), ("d", 1, ""), ("e", 0, ""), ("d", 12, "fine")],
        "doc_id string, page_no int, text string",
    )
    whole = {r.doc_id: r.text for r in C.assemble_pages(pages).collect()}
    assert whole == {"d": "unotrefine", "e": ""}
    parts = C.assemble_pages(pages, "\n", pages_per_part=10).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.part, r.text) for r in parts] == [
        ("d", 0, "uno\ntre"), ("d", 1, "fine"), ("e", 0, "")]
    kept, rejects = C.split_empty(C.assemble_pages(pages))
    assert kept.count() == 1 and rejects.first().error == "No text extracted from PDF"


def docs_frame(spark):
    return spark.createDataFrame(
        [("ok", "/p/ok.pdf", ORDER_TEXT), ("no", "/p/no.pdf", "appunto"), ("nil", "/p/nil.pdf", "")],
        "doc_id string, path string, text string",
    )


def test_ingest(spark, tmp_path):
    docs = docs_frame(spark)
    found = extract(docs)
    accepted, rejected = I.split_ingest(found)
    assert [r.doc_id for r in accepted.collect()] == ["ok"]
    assert {r.doc_id: r.reason for r in rejected.collect()} == {
        "no": "Dati insufficienti per creare ordine", "nil": "No text extracted from PDF"}
    report = I.ingest_report(found).first()
    assert (report.documents, report.n_accept, report.n_errors, report.pct_accept) == (3, 1, 2, 33)
    assert I.ingest_report(found.where("false")).first().pct_accept == 0
    judged = {r.doc_id: r for r in I.judged(found).collect()}
    assert judged["ok"].strict and judged["ok"].lenient and judged["ok"].number
    assert not judged["no"].lenient
    orders = I.orders_from_documents(accepted, as_of="2026-01-01").first()
    assert orders.due == dt.date(2026, 1, 1) and orders.order_no == "300000946"
    assert orders.note == "Estratto da: /p/ok.pdf" and orders.total_quantity == 5.0
    for batch in ("1", "2", "2"):  # a batch written again replaces itself
        C.write_report(*I.batch_results(found), str(tmp_path / "report"), batch)
    assert spark.read.json(str(tmp_path / "report" / "errors")).count() == 4
    C.write_orders(I.orders_from_documents(accepted), str(tmp_path / "orders"))
    C.write_orders(I.orders_from_documents(accepted), str(tmp_path / "orders"))
    assert spark.read.parquet(str(tmp_path / "orders")).count() == 2
    C.write_extraction(found, str(tmp_path / "x"), "1")
    assert spark.read.json(str(tmp_path / "x")).count() == 3
    assert [r.doc_id for r in I.skip_processed(docs, docs.where("doc_id = 'ok'")).collect()].count("ok") == 0
    assert extract_headers(docs).where("order_no is not null").count() == 1
    assert extract_items(docs).first().code == "AVAR0000000012"
    assert max(len(r["items"]) for r in Y.first_items(found, 0).collect()) == 0


def test_orders_json_file(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"order_id": "1", "cliente": "X"}) + "\n")
    assert O.orders_from_json(C.read_orders_json(spark, str(path))).first().client == "X"


def test_reconcile(spark):
    expected = spark.createDataFrame(
        [("a", "1", 2, None, 5.0, "rossi"), ("b", "2", None, 3, None, "verdi"), ("c", None, None, None, None, None)],
        "doc_id string, number string, articles long, min_articles long, quantity double, client string",
    )
    actual = spark.createDataFrame(
        [("a", "1", 2, 5.0, "Rossi SpA"), ("b", "9", 1, 1.0, "Neri"), ("d", "1", 1, 1.0, "x")],
        "doc_id string, order_no string, n_items long, total_quantity double, client string",
    )
    got = {r.doc_id: r.mismatches for r in Y.reconcile(expected, actual).collect()}
    assert got == {
        "a": [],
        "b": ["number: 2 != 9", "min_articles: 3 != 1", "client: verdi != Neri"],
        "c": ["document missing"],
        "d": ["document unexpected"],
    }


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_functions(spark):
    day = lambda s: value(spark, dates.day_month_year(F.lit(s)))
    assert day("il 5/2/26") == dt.date(2026, 2, 5) and day("05-12-1999") == dt.date(1999, 12, 5)
    assert day("31/02/2026") is None and day("x") is None
    assert [value(spark, dates.duration_text(F.lit(s))) for s in (59, 185, 7800, None)] == [
        "59s", "3m 5s", "2h 10m", None]
    assert [value(spark, dates.clock_text(F.lit(s))) for s in (5, 6001)] == ["00:05", "100:01"]
    assert value(spark, dates.italian_day(F.lit(dt.date(2026, 3, 1)))) == "1/3/2026"
    number = lambda s: value(spark, numbers.decimal_comma(F.lit(s)))
    assert [number(s) for s in ("2,50", "3", "1.000,00", "10f", "x")] == [2.5, 3.0, None, None, None]
    assert value(spark, numbers.truncated(F.lit("10,9"))) == 10.0
    assert value(spark, numbers.plain_quantity(F.lit(2.0))) == "2"
    assert value(spark, numbers.percent(F.lit(2), F.lit(3))) == 66
    assert value(spark, text.squeeze(F.lit(" a  b\tc "), 3)) == "a b"
    assert value(spark, text.first_match(F.lit("x"), "(y)")) is None
    assert value(spark, R.thickness_from_name(F.lit("pezzo_2.5mm.dxf"))) == 2.5
    table = [("13R", 9.0), ("13R025", 2.5)]
    assert value(spark, R.thickness_from_code(F.lit("13R025108-00"), table)) == 2.5
    assert value(spark, known_client(F.lit("/a/xy"), [("x", "first"), ("y", "second")])) == "first"


def test_first_per_code(spark):
    items = lambda *p: F.array(
        *[F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"), F.lit(1.0).alias("qty")) for c, n in p]
    )
    names = lambda c: [x.name for x in value(spark, c)]
    many = items(("b", "1"), ("a", "2"), ("b", "3"))
    assert names(first_per_code(many)) == ["1", "2"]
    assert names(first_per_code(many, items(("a", "4"), ("c", "5"), ("c", "6")))) == ["1", "2", "3", "5"]


def test_lines(spark):
    lines = F.array(*[F.lit(x) for x in ["h", "A1", "x", "9", "A2", "y", "8"]])
    is_code = lambda x: F.startswith(x, F.lit("A"))
    got = value(spark, N.blocks(lines, is_code))
    assert [(b.start, b.lines) for b in got] == [(1, ["A1", "x", "9"]), (4, ["A2", "y", "8"])]
    got = value(spark, N.blocks_ending(lines, is_code))
    assert [(b.start, b.lines) for b in got] == [(0, ["h", "A1"]), (2, ["x", "9", "A2"])]
    digit = lambda x: x.rlike("^[0-9]$")
    assert value(spark, N.first_within(lines, is_code, digit, 2)) == "9"
    assert value(spark, N.first_within(lines, is_code, digit, 1)) is None
    assert value(spark, N.until(lines, digit)) == ["h", "A1", "x"]
    assert value(spark, N.islands(lines, lambda x: ~digit(x), 3)) == [["h", "A1", "x"]]
    assert value(spark, N.text_before(F.lit("abcSpett"), ["Spett", "b"], 10)) == "abc"
    assert value(spark, N.text_before(F.lit("Spett"), ["Spett"], 10)) == ""


def test_calendar_crosses_the_year(spark):
    grid = R.month_grid(spark, "2025-12", "2025-12-24").orderBy("cell").collect()
    assert len(grid) == 42
    assert grid[0].day == dt.date(2025, 12, 1) and grid[-1].day == dt.date(2026, 1, 11)
    assert [g.day for g in grid if g.is_today] == [dt.date(2025, 12, 24)]
    assert sum(not g.other_month for g in grid) == 31
