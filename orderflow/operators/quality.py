"""Corpus profile, and reconciliation of extracted with expected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import all_matches, lines_of
from orderflow.operators.layout import layout_name

# Marks that tell layouts apart, article code and quantity shapes.
MARKS = {
    "deca": "DECA",
    "order": "ORDINE FORNITORE",
    "division": "DIVISIONE CUCINE",
    "bebitalia": "B&B ITALIA",
    "aza": "AZA INTERNATIONAL",
}
CODE_TOKEN = r"[A-Z]{2,}[0-9]+[A-Z0-9-]*"
QTY_TOKEN = r"[0-9]+[.,][0-9]+"


def document_profile(docs: DataFrame, code: str = CODE_TOKEN, qty: str = QTY_TOKEN) -> DataFrame:
    """Size, marks, distinct article codes and quantity tokens per document."""
    upper = docs.withColumn("_upper", F.upper("text"))
    return upper.select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        F.size(lines_of(F.col("text"))).cast("long").alias("lines"),
        layout_name(F.col("text"), F.col("_upper")).alias("layout"),
        *[F.contains("_upper", F.lit(m)).alias(f"has_{n}") for n, m in MARKS.items()],
        F.size(F.array_distinct(all_matches(F.col("text"), code)))
        .cast("long")
        .alias("codes"),
        F.regexp_count("text", F.lit(qty)).cast("long").alias("quantities"),
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("layout").agg(
        F.count("*").alias("documents"),
        F.sum("chars").alias("chars"),
        F.sum("lines").alias("lines"),
        F.sum("codes").alias("codes"),
        F.sum("quantities").alias("quantities"),
    )


def line_marks(lines: DataFrame) -> DataFrame:
    """Marks per document when the text is already cut into lines.

    A boolean OR combines before the shuffle, so long documents stay cheap.
    """
    upper = F.upper("line")
    return lines.groupBy("doc_id").agg(
        *[F.bool_or(F.contains(upper, F.lit(m))).alias(f"has_{n}") for n, m in MARKS.items()]
    )


def _differs(label: str, expected: Column, actual: Column, wrong: Column) -> Column:
    message = F.concat(
        F.lit(f"{label}: "),
        F.coalesce(expected.cast("string"), F.lit("-")),
        F.lit(" != "),
        F.coalesce(actual.cast("string"), F.lit("-")),
    )
    return F.when(wrong, message)


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against extracted documents, with the list of mismatches.

    ``expected`` holds doc_id and any of number, articles, min_articles,
    quantity and client (matched anywhere in the name, in any case).
    """
    e, a = expected.alias("e"), actual.alias("a")
    both = F.col("e.doc_id").isNotNull() & F.col("a.doc_id").isNotNull()
    given = set(expected.columns)
    checks = [
        F.when(F.col("a.doc_id").isNull(), F.lit("document missing")),
        F.when(F.col("e.doc_id").isNull(), F.lit("document unexpected")),
    ]

    def unequal(field: str, mine: str) -> Column:
        want, got = F.col(f"e.{field}"), F.col(f"a.{mine}")
        return _differs(
            field, want, got, both & want.isNotNull() & ~want.eqNullSafe(got)
        )

    if "number" in given:
        checks.append(unequal("number", "order_no"))
    if "articles" in given:
        checks.append(unequal("articles", "n_items"))
    if "quantity" in given:
        checks.append(unequal("quantity", "total_quantity"))
    if "min_articles" in given:
        want, got = F.col("e.min_articles"), F.col("a.n_items")
        checks.append(_differs("min_articles", want, got, both & (got < want)))
    if "client" in given:
        want, got = F.col("e.client"), F.coalesce(F.col("a.client"), F.lit(""))
        inside = F.contains(F.lower(got), F.lower(want))
        checks.append(_differs("client", want, got, both & ~inside))
    mismatches = F.array_compact(F.array(*checks))
    return e.join(a, F.col("e.doc_id") == F.col("a.doc_id"), "full_outer").select(
        F.coalesce(F.col("e.doc_id"), F.col("a.doc_id")).alias("doc_id"),
        mismatches.alias("mismatches"),
        (F.size(mismatches) == 0).alias("passed"),
    )


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first n documents by path: a quick look at a corpus."""
    return docs.orderBy("path").limit(n)


def first_items(extracted: DataFrame, n: int) -> DataFrame:
    """The first n items of every document."""
    return extracted.withColumn("items", F.slice("items", 1, n))
