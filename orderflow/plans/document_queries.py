"""Catalogue queries over documents: lines, layouts, extraction, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.dates import iso_day
from orderflow.functions.text import all_matches, contains_any, first_of, lines_of, matches, strip
from orderflow.operators import ingest as I
from orderflow.operators import lines as N
from orderflow.operators import quality as Y
from orderflow.operators import extraction as X
from orderflow.operators.extraction import extract, extract_items
from orderflow.operators.extractors.common import known_client
from orderflow.operators.extractors.for_ordine import KNOWN_CLIENTS
from orderflow.operators.extractors import generic
from orderflow.operators.layout import Layout, classify_layout, register_layout
from orderflow.operators.lines import explode_lines
from orderflow.operators.matching import first_by_rules, first_contained
from orderflow.operators.mdtable import markdown_cells, markdown_items as table_rows
from orderflow.plans.rendering import render, render_mixed
from orderflow.sources import corpus as C
from orderflow.sources import workorders as W



def _text():
    # Columns need a running session, so none is made at import time.
    return F.col("text")


def _documents(spark, folder) -> DataFrame:
    return W.table(spark, folder, "documents").select("doc_id", "text")


def doc_lines(spark, folder):
    return explode_lines(_documents(spark, folder)).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def doc_head(spark, folder):
    return _documents(spark, folder).select(
        "doc_id",
        N.head_chars(_text(), 500).alias("head"),
        N.text_before(_text(), ["License", "the"], 1000).alias("before_mark"),
        F.array_join(N.head_lines(_text(), 30), "/").alias("head_lines"),
    )


def first_documents(spark, folder):
    """The first eight documents of the rendered corpus, by path."""
    docs = render_mixed(spark, folder).select("path", "doc_id")
    return Y.first_documents(docs, 8)


def doc_layout(spark, folder):
    return classify_layout(_documents(spark, folder)).select("doc_id", "layout")


def doc_first_line(spark, folder):
    """First ordinary line, its neighbours, and the first wanted line near it."""

    def ordinary(x):
        return (F.length(x) > 20) & ~matches(x, r"^(The|Der|La|El) ")

    lines = N.stripped_lines(_text())
    return _documents(spark, folder).select(
        "doc_id",
        N.first_line(lines, ordinary).alias("first_line"),
        N.first_neighbour(lines, lambda p, x, n: F.when(ordinary(x) & p.isNotNull(), p)).alias(
            "previous"
        ),
        N.first_neighbour(lines, lambda p, x, n: F.when(ordinary(x) & n.isNotNull(), n)).alias(
            "following"
        ),
        N.first_within(
            lines, ordinary, lambda x: F.contains(x, F.lit("an")), 4
        ).alias("near"),
    )


def doc_profile(spark, folder):
    return Y.document_profile(_documents(spark, folder))


def doc_profile_summary(spark, folder):
    return Y.profile_summary(Y.document_profile(_documents(spark, folder)))


def doc_line_marks(spark, folder):
    return Y.line_marks(explode_lines(render_mixed(spark, folder)))


def block_segments(spark, folder):
    """Lines in capitals A to E open a block; first line with a digit inside."""
    found = N.segment_blocks(_documents(spark, folder), r"^[A-E]")
    return found.select(
        "doc_id",
        F.col("block_no").cast("long").alias("block_no"),
        F.col("start").cast("long").alias("start"),
        F.size("lines").cast("long").alias("n_lines"),
        N.first_line(F.col("lines"), lambda x: matches(x, "[0-9]")).alias("digit_line"),
        F.length(F.array_join(F.slice("lines", F.lit(3), F.size("lines")), " "))
        .cast("long")
        .alias("tail_chars"),
    )


def doc_islands(spark, folder):
    """Runs of at least three lines that hold a comma."""
    runs = N.islands(lines_of(_text()), lambda x: F.contains(x, F.lit(",")), 3)
    return (
        _documents(spark, folder)
        .select("doc_id", F.posexplode(runs).alias("island", "lines"))
        .select(
            "doc_id",
            F.col("island").cast("long").alias("island"),
            F.size("lines").cast("long").alias("n_lines"),
            first_of(F.col("lines")).alias("first_line"),
        )
    )


def doc_until(spark, folder):
    """Lines before the first line that names a license or holds a digit."""
    stop = lambda x: contains_any(x, ["License", "license"]) | matches(x, "[0-9]")
    return _documents(spark, folder).select(
        "doc_id",
        F.size(N.until(lines_of(_text()), stop)).cast("long").alias("n_lines"),
    )


def doc_code_segments(spark, folder):
    """Text between one capital word and the next, as rows."""
    segments = F.filter(
        F.split(_text(), r"(?<![A-Z])(?=[A-Z]{2,})", -1), lambda p: matches(p, "^[A-Z]{2,}")
    )
    return _documents(spark, folder).select(
        "doc_id", F.posexplode(segments).alias("segment", "part")
    ).select(
        "doc_id",
        F.col("segment").cast("long").alias("segment"),
        F.regexp_extract("part", "^[A-Z]+", 0).alias("word"),
    )


def page_texts(spark, folder):
    """Conversation turns joined in order, as pages of a document."""
    turns = W.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )
    return C.assemble_pages(turns, separator="\n")


def html_titles(spark, folder):
    """First heading of raw pages: first match of several patterns."""
    pages = W.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        F.coalesce(
            F.nullif(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("")),
            F.nullif(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1), F.lit("")),
        ).alias("title"),
    )


def _items(spark, folder, layout: str) -> DataFrame:
    return extract_items(render(spark, folder, layout))


def _layout_query(layout: str):
    def query(spark, folder):
        return _items(spark, folder, layout)

    return query


def mixed_extraction(spark, folder, *headers: str) -> DataFrame:
    """Items of the mixed corpus, and these header fields."""
    return extract(render_mixed(spark, folder), headers=headers)


def extract_headers(spark, folder):
    return X.extract_headers(render_mixed(spark, folder)).select(
        "doc_id",
        "layout",
        "client",
        "order_no",
        iso_day(F.col("due")).alias("due"),
        iso_day(F.col("received")).alias("received"),
        "error",
    )


def extract_mixed_items(spark, folder):
    return extract_items(render_mixed(spark, folder))


def extract_totals(spark, folder):
    return mixed_extraction(spark, folder, "due").select(
        "doc_id", "n_items", "total_quantity", "due_missing", "needs_tables"
    )


def rendered_layout(spark, folder):
    return classify_layout(render_mixed(spark, folder)).groupBy("layout").agg(
        F.count("*").alias("documents")
    )


def ingest_report(spark, folder):
    return I.ingest_report(mixed_extraction(spark, folder, "client", "order_no"))


def ingest_by_layout(spark, folder):
    found = mixed_extraction(spark, folder, "order_no")
    return I.ingest_report(found, "layout", rules=("accept",)).select(
        "layout", "documents", "n_accept", "n_errors", "items", "pieces", "pct_accept"
    )


def ingest_rejects(spark, folder):
    _, rejected = I.split_ingest(mixed_extraction(spark, folder, "order_no"))
    return I.error_lines(rejected)


def ingest_orders(spark, folder):
    accepted, _ = I.split_ingest(mixed_extraction(spark, folder, "client", "order_no", "due"))
    return I.orders_from_documents(accepted, as_of="2000-01-01").select(
        "order_id",
        "client",
        iso_day(F.col("due")).alias("due"),
        F.size("articles").cast("long").alias("n_articles"),
        "total_quantity",
        "note",
    )


def ingest_new_paths(spark, folder):
    """Documents not ingested before; paths of even orders count as done."""
    docs = render_mixed(spark, folder).select("doc_id", "path")
    done = docs.where(F.split_part("doc_id", F.lit("-"), F.lit(1)).cast("long") % 2 == 0)
    return I.skip_processed(docs, done)


def ingest_times(spark, folder):
    """Time statistics of an ingest log: a millisecond per character."""
    log = classify_layout(_documents(spark, folder)).select(
        "layout", (F.length("text") / F.lit(1000.0)).alias("seconds")
    )
    return I.time_statistics(log, "layout").select(
        "layout",
        "documents",
        F.round("total_seconds", 3).alias("total_seconds"),
        F.round("mean_seconds", 6).alias("mean_seconds"),
        "max_seconds",
    )


def client_dictionary(spark, folder):
    docs = render_mixed(spark, folder)
    return docs.select("doc_id", known_client(F.col("path"), KNOWN_CLIENTS).alias("client"))


def client_by_path(spark, folder):
    """Clients of pages by a dictionary table of as many keys as there are customers."""
    pages = W.table(spark, folder, "pages").select("page_id", "url")
    entries = W.table(spark, folder, "customer").select(
        F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("client"), "c_custkey"
    )
    return first_contained(pages, entries, "page_id", "url", "key", "client", "c_custkey")


#: Two rule tables: rule set, layout, priority, kind of word, word.
RULES = [
    ("terms", "MIT", 1, "all", "MIT"),
    ("terms", "MIT", 1, "all", "LICENSE"),
    ("terms", "APACHE", 2, "all", "APACHE"),
    ("terms", "APACHE", 2, "any", "LICENSE"),
    ("terms", "APACHE", 2, "any", "VERSION"),
    ("terms", "GPL", 3, "any", "GENERAL PUBLIC"),
    ("terms", "GPL", 3, "any", "GPL"),
    ("terms", "OTHER", 9, "any", None),
    ("contact", "MAIL", 1, "all", "@"),
    ("contact", "MAIL", 1, "any", ".COM"),
    ("contact", "MAIL", 1, "any", ".ORG"),
    ("contact", "PHONE", 2, "any", "+"),
    ("contact", "LETTER", 3, "all", "THE"),
    ("contact", "LETTER", 3, "all", "ING"),
]


def layout_by_rules(spark, folder):
    """Documents by two tables of rules; the second leaves out what none of its rules fits."""
    rules = spark.createDataFrame(RULES, "rule_set string, layout string, priority int, kind string, word string")
    return first_by_rules(_documents(spark, folder), rules)


def layout_registered(spark, folder):
    """Documents per layout where a layout of licensed texts is registered before the general one."""
    licensed = Layout("LICENZA", lambda text, upper: F.contains(upper, F.lit("LICENSE")), generic.header, generic.items)
    return classify_layout(_documents(spark, folder), register_layout(licensed)).groupBy("layout").agg(
        F.count("*").alias("documents")
    )


def reconcile(spark, folder):
    """Source articles as expectation against what the mixed corpus yields."""
    lines = W.work_lines(spark, folder)
    expected = (
        W.work_orders(spark, folder, client=False)
        .select("order_id")
        .join(
            lines.groupBy("order_id").agg(
                F.count("*").alias("articles"), F.sum("qty").alias("quantity")
            ),
            "order_id",
            "left",
        )
        .select(
            F.col("order_id").cast("string").alias("doc_id"),
            F.coalesce("articles", F.lit(0)).alias("articles"),
            F.coalesce("quantity", F.lit(0.0)).cast("long").alias("quantity"),
        )
    )
    actual = mixed_extraction(spark, folder).withColumn(
        "total_quantity", F.col("total_quantity").cast("long")
    )
    return Y.reconcile(expected, actual).select(
        "doc_id", F.array_join("mismatches", "; ").alias("mismatches"), "passed"
    )


def item_rejects(spark, folder):
    """Articles called headings, and articles of no pieces, in orders of one layout."""
    docs = render(spark, folder, "FOR_ORDINE")
    spoilt = F.regexp_replace(F.regexp_replace("text", "(?i)widget", "prodotto"), " 23,23 50 ", " 23,23 0 ")
    return X.item_rejects(docs.withColumn("text", spoilt)).drop("layout")


def markdown_items(spark, folder):
    return table_rows(render(spark, folder, "TABLE")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def markdown_cells_count(spark, folder):
    return markdown_cells(render(spark, folder, "TABLE")).groupBy("row_no", "col_no").agg(
        F.count("*").alias("cells")
    ).select(
        F.col("row_no").cast("long").alias("row_no"),
        F.col("col_no").cast("long").alias("col_no"),
        "cells",
    )


def table_fallback(spark, folder):
    """Documents whose own text has no items take them from the table text."""
    docs = render(spark, folder, "TABLE").select(
        "doc_id",
        "path",
        F.lit("DIVISIONE CUCINE").alias("text"),
        F.col("text").alias("tables"),
    )
    return extract(docs, table_text="tables", headers=False).select(
        "doc_id", "layout", "n_items", "total_quantity"
    )


QUERIES = {
    f.__name__: f
    for f in (
        doc_lines, doc_head, first_documents, doc_layout, doc_first_line, doc_profile,
        doc_profile_summary, doc_line_marks, block_segments, doc_islands,
        doc_until, doc_code_segments, page_texts, html_titles,
        extract_headers, extract_mixed_items, extract_totals, rendered_layout,
        ingest_report, ingest_by_layout, ingest_rejects, ingest_orders,
        ingest_new_paths, ingest_times, client_dictionary, client_by_path, layout_by_rules,
        layout_registered, item_rejects, reconcile,
        markdown_items, markdown_cells_count, table_fallback,
    )
}
QUERIES |= {
    "extract_divisione_items": _layout_query("DIVISIONE"),
    "extract_bebitalia_items": _layout_query("PO_BEBITALIA"),
    "extract_aza_items": _layout_query("FOR_ORDINE_AZA"),
    "extract_for_ordine_items": _layout_query("FOR_ORDINE"),
    "extract_oafa_items": _layout_query("OAFA"),
    "extract_ls_items": _layout_query("ORDINE_LS"),
    "extract_generic_items": _layout_query("GENERIC"),
}
