"""Acceptance of extracted documents, batch report and incremental pick-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.numbers import percent
from orderflow.operators.orders import default_phases
from orderflow.schemas import RECEIVED, UNKNOWN_CLIENT

# Messages of the batch report.
INSUFFICIENT = "Dati insufficienti per creare ordine"
NOTE_PREFIX = "Estratto da: "


def _filled(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0)) > 0


def acceptance_rules() -> dict[str, Column]:
    """``accept`` creates orders; the others are success measures of a batch."""
    some = F.col("n_items") > 0
    return {
        "accept": _filled("order_no") & some,
        "strict": _filled("client") & _filled("order_no") & some,
        "lenient": F.col("error").isNull() & some,
        "number": _filled("order_no"),
    }


def judged(extracted: DataFrame) -> DataFrame:
    """Extracted documents with one boolean column per rule."""
    return extracted.withColumns(acceptance_rules())


def split_ingest(extracted: DataFrame, rule: str = "accept") -> tuple[DataFrame, DataFrame]:
    """Accepted documents, and rejected ones with a reason."""
    ok = acceptance_rules()[rule]
    rejected = extracted.where(~ok).withColumn(
        "reason", F.coalesce("error", F.lit(INSUFFICIENT))
    )
    return extracted.where(ok), rejected


def orders_from_documents(accepted: DataFrame, as_of: str | None = None) -> DataFrame:
    """Orders of accepted documents; ``as_of`` fills a missing due date."""
    due = F.col("due")
    if as_of:
        due = F.coalesce(due, F.to_date(F.lit(as_of)))
    return accepted.select(
        F.col("doc_id").alias("order_id"),
        F.coalesce("client", F.lit(UNKNOWN_CLIENT)).alias("client"),
        "order_no",
        due.alias("due"),
        F.transform(
            "items",
            lambda a: F.struct(
                a["name"].alias("name"), a["code"].alias("code"), a["qty"].alias("qty")
            ),
        ).alias("articles"),
        default_phases(F.array().cast("array<string>")).alias("required_phases"),
        "total_quantity",
        F.lit(RECEIVED).alias("status"),
        F.concat(F.lit(NOTE_PREFIX), "path").alias("note"),
    )


def ingest_report(extracted: DataFrame, *groups: str, rules: Sequence[str] | None = None) -> DataFrame:
    """Counts and success percentages, over all documents or per group.

    ``rules`` names the rules to count; ``accept``, which gives the errors, is always there.
    """
    known = acceptance_rules()
    rules = known if rules is None else {name: known[name] for name in ("accept", *rules)}
    counts = extracted.groupBy(*groups).agg(
        F.count("*").alias("documents"),
        *[F.count_if(ok).alias(f"n_{name}") for name, ok in rules.items()],
        F.sum("n_items").alias("items"),
        F.sum("total_quantity").alias("pieces"),
    )
    return counts.withColumn("n_errors", F.col("documents") - F.col("n_accept")).withColumns(
        {f"pct_{name}": percent(F.col(f"n_{name}"), F.col("documents")) for name in rules}
    )


def time_statistics(log: DataFrame, *groups: str) -> DataFrame:
    """Documents, total and mean seconds of an ingest log with ``seconds``."""
    return log.groupBy(*groups).agg(
        F.count("*").alias("documents"),
        F.sum("seconds").alias("total_seconds"),
        F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("max_seconds"),
    )


def skip_processed(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose path has not been ingested before."""
    return docs.join(processed.select("path"), "path", "left_anti")


def batch_results(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result lines and error lines of a batch, as the report lists them."""
    accepted, rejected = split_ingest(extracted)
    results = accepted.select(
        "path",
        F.col("doc_id").alias("order_id"),
        "client",
        "order_no",
        F.col("n_items").alias("n_articles"),
        F.lit("success").alias("status"),
    )
    return results, error_lines(rejected)


def error_lines(rejected: DataFrame) -> DataFrame:
    return rejected.select("path", F.col("reason").alias("error"))
