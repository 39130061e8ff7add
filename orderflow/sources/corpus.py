"""Document corpora: reading, page assembly, rejects, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.operators.extraction import NO_TEXT


def suffix_glob(suffix: str) -> str:
    """Glob for names ending in ``suffix`` in any case."""
    letters = [f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix]
    return "*" + "".join(letters)


def read_corpus(
    spark: SparkSession, path: str, suffix: str = ".txt", recursive: bool = False
) -> DataFrame:
    """One row per file whose name ends in ``suffix`` in any case; its path is its id.

    The case-blind glob keeps other files from being opened at all.
    """
    files = (
        spark.read.option("pathGlobFilter", suffix_glob(suffix))
        .option("recursiveFileLookup", str(recursive).lower())
        .text(path, wholetext=True)
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("value").alias("text"),
    )


def assemble_pages(
    pages: DataFrame, separator: str = "", pages_per_part: int | None = None
) -> DataFrame:
    """Page texts (doc_id, page_no, text) joined per document, blank pages dropped.

    A file is one row. ``pages_per_part`` cuts it into parts of so many pages,
    with a column ``part``, where a file may be too long for one value.
    """
    keys = ["doc_id"]
    if pages_per_part:
        keys.append(F.floor(F.col("page_no") / pages_per_part).cast("long").alias("part"))
    return (
        pages.groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("text") != "", F.struct("page_no", "text")))
            ).alias("_pages")
        )
        .select(
            "doc_id",
            *(["part"] if pages_per_part else []),
            F.array_join(
                F.transform("_pages", lambda p: p["text"]), separator
            ).alias("text"),
        )
    )


def split_empty(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and error rows for those without."""
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    rejects = docs.where(empty).drop("text").withColumn("error", F.lit(NO_TEXT))
    return docs.where(~empty), rejects


def write_orders(orders: DataFrame, path: str, partition: str = "status") -> None:
    """Append orders; a day or the status keeps the number of folders small."""
    orders.write.mode("append").partitionBy(partition).parquet(path)


def write_orders_batch(orders: DataFrame, path: str, batch: str, partition: str = "status") -> None:
    """Write a batch of orders; writing it again replaces its own partitions and no other.

    A status that the repeated batch no longer has keeps what it had, so a batch
    is repeated with the same rows, as a restart does.
    """
    rows = orders.withColumn("batch", F.lit(batch))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch", partition).parquet(path)


def write_report(results: DataFrame, errors: DataFrame, path: str, batch: str, compression: str = "none") -> None:
    """Result and error lines of a batch as JSON files, in a folder of the batch.

    Writing a batch again replaces its own folder and no other.
    """
    results.write.mode("overwrite").json(f"{path}/results/batch={batch}", compression=compression)
    errors.write.mode("overwrite").json(f"{path}/errors/batch={batch}", compression=compression)


def write_extraction(extracted: DataFrame, path: str, batch: str) -> None:
    extracted.write.mode("overwrite").json(f"{path}/batch={batch}")


def read_orders_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON order request per line, as text for ``orders_from_json``."""
    return spark.read.text(path).select(F.col("value").alias("json"))
