"""Catalogue queries that run the phase events through a stream."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.dates import iso_time
from orderflow.plans.order_queries import _steps
from orderflow.session import checkpoint_dir, is_folder
from orderflow.sources import workorders as W
from orderflow.streaming.expiry import write_fold_ttl
from orderflow.streaming.fold import current_steps, read_fold, write_fold
from orderflow.streaming.notifications import order_plans
from orderflow.streaming.notifications import stream_notifications as notify
from orderflow.streaming.pickup import stream_corpus, stream_documents


# Events in a file of the late stream.
EVENTS_PER_FILE = 100_000
# Bytes, about, in a file of documents that arrive.
FILE_BYTES = 8 << 20


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream, be it one file or a folder of part files."""
    reader = spark.readStream.schema(W.table(spark, folder, "events").schema)
    path = f"{folder}/events.parquet"
    if is_folder(spark, path):
        return W.phase_events(reader.parquet(path))
    return W.phase_events(reader.option("pathGlobFilter", "events.parquet").parquet(folder))


def _new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint space for one run."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream_steps(spark, folder, stateful: bool) -> DataFrame:
    base = _new_folder(spark)
    query = write_fold(
        event_stream(spark, folder), f"{base}/fold", f"{base}/state", stateful=stateful
    )
    query.awaitTermination()
    return _steps(_logged_steps(spark, folder, base))


def _logged_steps(spark, folder, base: str) -> DataFrame:
    """Steps from the log below a run's folder."""
    fold = read_fold(spark, f"{base}/fold")
    return current_steps(fold, W.work_articles(spark, folder), lines=W.work_lines(spark, folder))


def stream_step_fold(spark, folder):
    return _stream_steps(spark, folder, stateful=False)


def stream_step_fold_stateful(spark, folder):
    return _stream_steps(spark, folder, stateful=True)


def stream_late_events(spark, folder):
    """Events that arrive latest first, a third in a batch: every one of them late."""
    base = _new_folder(spark)
    write_fold(_late_stream(spark, folder, base), f"{base}/fold", f"{base}/state", stateful=True).awaitTermination()
    return _steps(_logged_steps(spark, folder, base))


def _late_stream(spark, folder, base: str) -> DataFrame:
    """The event stream with its latest third first, each third in one batch.

    A third is written as so many files that none grows with the table; all
    thirds have as many, which is what a batch takes.
    """
    events = W.table(spark, folder, "events")
    first, last, n = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    third = (last - first) / 3
    files = max(1, math.ceil(n / 3 / EVENTS_PER_FILE))
    for i in (2, 1, 0):
        since, until = F.col("ts") >= F.lit(first + i * third), F.col("ts") < F.lit(first + (i + 1) * third)
        part = {2: since, 1: since & until, 0: until | F.col("ts").isNull()}[i]
        rows = events.where(part)
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
    return W.phase_events(stream.parquet(f"{base}/in"))


def stream_step_fold_ttl(spark, folder):
    """State of finished steps expires at once, and late events follow: the log has it all."""
    base = _new_folder(spark)
    write_fold_ttl(_late_stream(spark, folder, base), f"{base}/fold", f"{base}/state", keep_ms=0).awaitTermination()
    return _steps(_logged_steps(spark, folder, base))


def stream_step_notes(spark, folder):
    """Notes by way of the stream's log, written in late batches and compacted between them."""
    base = _new_folder(spark)
    write_fold(_late_stream(spark, folder, base), f"{base}/fold", f"{base}/state", compact_every=2).awaitTermination()
    steps = _logged_steps(spark, folder, base)
    return steps.where(F.col("note").isNotNull()).select("order_id", "phase", "note")


def stream_notifications(spark, folder):
    base = _new_folder(spark)
    plans = []
    for name, plan in zip(("steps", "articles"), order_plans(W.work_articles(spark, folder)), strict=True):
        plan.write.parquet(f"{base}/{name}")
        plans.append(spark.read.parquet(f"{base}/{name}"))
    query = notify(event_stream(spark, folder), *plans, f"{base}/notified", f"{base}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/notified").select(
        "order_id",
        iso_time(F.col("created_at")).alias("created_at"),
        "message",
        "viewed",
        "seconds",
    )


def stream_pickup(spark, folder):
    """Documents as text files by eighths, half of these there at first; two starts of one stream.

    An eighth is as many files as it takes for none to grow with the table, as a
    file is read as one value; a start takes its half in two batches.
    """
    base, eighth = _new_folder(spark), F.col("doc_id") % 8
    texts = W.table(spark, folder, "documents").select(F.coalesce("text", F.lit("")).alias("text"), eighth.alias("eighth"))

    def arrive(half) -> DataFrame:
        rows = texts.where(half)
        size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        # Every part holds rows of four eighths.
        parts = max(1, math.ceil(size / 4 / FILE_BYTES))
        rows.repartition(parts).write.mode("append").partitionBy("eighth").option("compression", "none").text(f"{base}/in")
        return stream_corpus(spark, f"{base}/in", files_per_trigger=2 * parts)

    docs = arrive(F.col("eighth") < 4)
    query = stream_documents(docs, f"{base}/out", f"{base}/state", every="1 second")
    query.processAllAvailable()
    query.stop()
    docs = arrive((F.col("eighth") >= 4) | F.col("eighth").isNull())
    stream_documents(docs, f"{base}/out", f"{base}/state").awaitTermination()
    kept = spark.read.parquet(f"{base}/out")
    # A null eighth has a folder without a number.
    eighth = F.nullif(F.regexp_extract("path", "eighth=(-?[0-9]+)", 1), F.lit("")).cast("long")
    return kept.groupBy(eighth.alias("eighth")).agg(F.sum(F.length("text")).cast("long").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_step_fold, stream_step_fold_stateful, stream_step_fold_ttl, stream_step_notes,
        stream_late_events, stream_notifications, stream_pickup,
    )
}
