"""Incremental pick-up: every document file is extracted exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderflow.operators.extraction import extract
from orderflow.operators.ingest import split_ingest
from orderflow.sources.corpus import suffix_glob
from orderflow.streaming.fold import _run

WHOLE_FILES = {
    "parquet.block.size": 16 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}


def stream_corpus(
    spark: SparkSession, path: str, suffix: str = ".txt", files_per_trigger: int | None = None
) -> DataFrame:
    """Documents of a folder as a stream; the checkpoint remembers seen files."""
    reader = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", suffix_glob(suffix))
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("value").alias("text"),
    )


def stream_extraction(
    docs: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Extract arriving documents into ``accepted`` and ``rejected`` folders.

    The extraction is written once per batch and split from what was written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        extract(batch).write.mode("overwrite").parquet(f"{path}/extracted/batch={batch_id}")
        written = spark.read.parquet(f"{path}/extracted/batch={batch_id}")
        accepted, rejected = split_ingest(written)
        accepted.write.mode("overwrite").parquet(f"{path}/accepted/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")

    return _run(docs, write, checkpoint, "append", every)


def stream_documents(docs: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep arriving documents as they are, a folder for each batch: every file once, over all starts.

    A row is a whole file, so a writer looks at its memory after every row, and
    row groups are small, as a reader holds one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").options(**WHOLE_FILES).parquet(f"{path}/batch={batch_id}")

    return _run(docs, write, checkpoint, "append", every)
