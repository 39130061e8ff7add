"""Phase events as a stream, folded into the current state of every step.

State is kept per (order, phase, article index), never per order, and every
field is a minimum, or a maximum for the last note. A hot order therefore spreads over many keys, map-side
combining shrinks its repeats, and results of batches merge in any order.
The sink is a log of folded rows, one folder per batch: writing a batch again
replaces its folder, so a restart after a lost executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderflow.operators.phases import completions, fold_steps, seed_steps
from orderflow.schemas import COMPLETE, COMPLETE_PARTIAL, START
from orderflow.session import delete_path, numbered_folders

KEY = ["order_id", "phase", "idx"]
FIELDS = ["start", "complete", "done_ts", "partial"]


def _marks(events: DataFrame) -> DataFrame:
    written = F.struct("ts", "event_id", "note")
    indices = F.when(F.col("action") == COMPLETE_PARTIAL, F.col("article_indices"))
    return events.select(
        "event_id",
        "order_id",
        "phase",
        F.explode_outer(indices).alias("idx"),
        F.when(F.col("action") == START, F.struct("ts", "event_id", "operator")).alias("start"),
        F.when(F.col("action") == COMPLETE, written).alias("complete"),
        F.when(F.col("action") == COMPLETE_PARTIAL, F.col("ts")).alias("done_ts"),
        F.when(F.col("action") == COMPLETE_PARTIAL, written).alias("partial"),
    )


def _fold(marks: DataFrame) -> DataFrame:
    return marks.groupBy(*KEY).agg(
        # Equal times go to the lower event id, as in the batch fold.
        F.min("start").alias("start"),
        F.min("complete").alias("complete"),
        F.min("done_ts").alias("done_ts"),
        # The last note among partial completions; the later event wins equal times.
        F.max("partial").alias("partial"),
    )


def fold_stream(events: DataFrame) -> DataFrame:
    """Running fold of a stream, for update mode.

    Repeated deliveries cannot change a minimum, and without a watermark no
    event is too late. The state grows with the steps ever seen; a job that
    runs for long takes the form without state.
    """
    return _fold(_marks(events))


def fold_batch(events: DataFrame) -> DataFrame:
    """Fold of the events of one batch alone.

    Together with the merging reader this needs no state store at all: no
    state grows with open orders and no event is ever too late.
    """
    return _fold(_marks(events))


def _run(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    every: str | None,
) -> StreamingQuery:
    """Drain what is available, or go on with a trigger interval."""
    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def as_log(rows: DataFrame) -> DataFrame:
    """Folded rows in the columns of the log, whatever kept them."""
    return rows.select(*KEY, *FIELDS)


def write_fold(
    events: DataFrame,
    path: str,
    checkpoint: str,
    stateful: bool = False,
    every: str | None = None,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Write folded rows of a phase-event stream to the log under ``path``.

    With ``compact_every`` the batches before every so many are merged into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if stateful else fold_batch(batch)
        as_log(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_fold(batch.sparkSession, path, batch_id)

    if stateful:
        return _run(fold_stream(events), write, checkpoint, "update", every)
    return _run(events, write, checkpoint, "append", every)


def compact_fold(spark: SparkSession, path: str, before: int) -> None:
    """Merge the log's batches before a batch number into one folder, named by its negative.

    Merged rows are written first and the merged folders deleted after. Rows that
    are there twice, after a crash in between, change no minimum; the next call
    clears them. The last batch stays out, as a restart may write it again. To be
    called by the log's one writer; readers that have listed a folder may need to
    list anew.
    """
    folders = [(n, f) for n, f in numbered_folders(spark, path, "batch=") if n < before and n != -before]
    if len(folders) > 1:
        _fold(spark.read.parquet(*[f for _, f in folders])).write.mode("overwrite").parquet(f"{path}/batch={-before}")
        for _, folder in folders:
            delete_path(spark, folder)


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """Current fold: the rows of all batches merged."""
    return _fold(spark.read.parquet(path))


def as_events(fold: DataFrame) -> DataFrame:
    """Folded rows as the few events that still matter: the first of each kind,
    and the partial completion that wrote the last note."""
    indices = F.when(F.col("idx").isNotNull(), F.array("idx"))
    first_done = F.struct(
        F.col("done_ts").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("note")
    )

    def event(action: str, at: Column, operator: Column | None = None) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            at["ts"].alias("ts"),
            at["event_id"].alias("event_id"),
            (F.lit(None) if operator is None else operator).cast("string").alias("operator"),
            (F.lit(None) if operator is not None else at["note"]).cast("string").alias("note"),
            (indices if action == COMPLETE_PARTIAL else F.lit(None)).cast("array<int>").alias("article_indices"),
        )

    kinds = F.array(
        event(START, F.col("start"), F.col("start.operator")),
        event(COMPLETE, F.col("complete")),
        event(COMPLETE_PARTIAL, first_done),
        event(COMPLETE_PARTIAL, F.col("partial")),
    )
    return fold.select("order_id", "phase", F.inline(F.filter(kinds, lambda k: k["ts"].isNotNull())))


def current_steps(
    fold: DataFrame, articles: DataFrame, mode: str = "contract", lines: DataFrame | None = None
) -> DataFrame:
    """Steps from a fold, by the same rules as from the full event log.

    ``lines`` are the articles without their position, where these can be had for
    less: steps are seeded from them, and the numbered articles are computed once.
    """
    events = as_events(fold)
    seeds = seed_steps(articles if lines is None else lines)
    return fold_steps(seeds, events, completions(events, articles), mode)
