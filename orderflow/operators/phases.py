"""Phase lifecycle: fold an append-only event log into the state of every step.

Every fold is a minimum, a maximum or a distinct set, so it does not depend on
event order, may be repeated safely, and combines on the map side: a single
hot order never gathers its raw events in one task.

Completion rules (``mode``):

* ``contract``: a phase ends when every article *requiring* it is done, and an
  ended phase counts as done for all articles of the order;
* ``code``: a phase ends when *all* articles of the order are marked, and
  ending a phase marks no article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.dates import duration_text, seconds_between
from orderflow.schemas import (
    COMPLETE,
    COMPLETE_PARTIAL,
    COMPLETED_MESSAGE,
    RECEIVED,
    SHIPPED,
    START,
)

MODES = ("contract", "code")


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def seed_steps(articles: DataFrame) -> DataFrame:
    """One step per (order, phase) that any article of the order requires.

    Phases are data: whatever name a list holds gets a step; null entries are
    none. ``seq`` is the first place the phase has in any list, counted without
    its null entries. Equal lists of an order are counted first, on the map side,
    so an order is one short row however many articles it has; its phases are
    then told apart inside the row.
    """
    lists = articles.groupBy(
        "order_id",
        F.array_distinct(
            F.array_compact(F.coalesce("required_phases", F.array().cast("array<string>")))
        ).alias("phases"),
    ).agg(F.count("*").alias("n"))
    # As many entries as an order has different lists.
    per_order = lists.groupBy("order_id").agg(
        F.sum("n").alias("n_articles"), F.collect_list(F.struct("phases", "n")).alias("lists")
    )

    def step(phase: Column) -> Column:
        has = F.filter("lists", lambda x: F.array_contains(x["phases"], phase))
        return F.struct(
            phase.alias("phase"),
            F.aggregate(has, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_required"),
            (F.array_min(F.transform(has, lambda x: F.array_position(x["phases"], phase))) - 1)
            .cast("int")
            .alias("seq"),
        )

    names = F.array_distinct(F.flatten(F.transform("lists", lambda x: x["phases"])))
    return per_order.select("order_id", "n_articles", F.inline(F.transform(names, step)))


def seed_order_steps(orders: DataFrame) -> DataFrame:
    """One step per entry of the order's own ``required_phases`` list."""
    return orders.select(
        "order_id", F.posexplode("required_phases").alias("seq", "phase")
    )


def explode_indices(events: DataFrame) -> DataFrame:
    """Partial completions as one row per (event, article index)."""
    return events.where(F.col("action") == COMPLETE_PARTIAL).select(
        "event_id", "order_id", "phase", "ts", F.explode("article_indices").alias("idx")
    )


def completions(events: DataFrame, articles: DataFrame) -> DataFrame:
    """First completion of each article in each phase.

    The index is checked by joining on (order, idx), which spreads even a hot
    order over many tasks; indices outside the article list drop out.
    """
    first = (
        explode_indices(events)
        .groupBy("order_id", "phase", "idx")
        .agg(F.min("ts").alias("done_at"))
        .withColumn("idx", F.col("idx").cast("long"))
    )
    known = articles.select("order_id", "idx", "required_phases")
    return first.join(known, ["order_id", "idx"]).select(
        "order_id",
        "phase",
        "idx",
        "done_at",
        F.array_contains("required_phases", F.col("phase")).alias("required"),
    )


def known_completions(done: DataFrame, seeds: DataFrame) -> DataFrame:
    """Completions in phases the order has a step for, with the place of the step;
    folding needs no such filter, as it starts from the steps."""
    known = [c for c in ("order_id", "phase", "seq") if c in seeds.columns]
    return done.join(seeds.select(*known), ["order_id", "phase"])


def fold_steps(
    seeds: DataFrame,
    events: DataFrame,
    done: DataFrame,
    mode: str = "contract",
) -> DataFrame:
    """Current state of every step: first start wins, first completion wins.

    ``done`` is the result of :func:`completions` over the same events. A step
    ends at its first whole-phase completion or at the completion of its last
    article, whichever comes first.

    The note is a register that its last writer wins, by (time, event id): each
    partial completion writes it, and the whole-phase completion that ended the
    step. A missing note is written like any other.
    """
    _check(mode)
    written = F.struct("ts", "event_id", "note")
    whole = events.select(
        "order_id",
        "phase",
        F.when(F.col("action") == START, F.struct("ts", "event_id", "operator")).alias("start"),
        F.when(F.col("action") == COMPLETE, written).alias("complete"),
        F.when(F.col("action") == COMPLETE_PARTIAL, written).alias("partial"),
    )
    counted = done.where(F.col("required")) if mode == "contract" else done
    # Equal times go to the lower event id, so the first start has one operator.
    marks = whole.groupBy("order_id", "phase").agg(
        F.min("start").alias("start"),
        F.min("complete").alias("complete"),
        F.max("partial").alias("partial"),
    )
    parts = counted.groupBy("order_id", "phase").agg(
        F.count("*").alias("n_done"), F.max("done_at").alias("last_done")
    )
    target = F.col("n_required" if mode == "contract" else "n_articles")
    return (
        seeds.join(marks, ["order_id", "phase"], "left")
        .join(parts, ["order_id", "phase"], "left")
        .select(
            "order_id",
            "phase",
            *(["seq"] if "seq" in seeds.columns else []),
            "n_articles",
            "n_required",
            F.coalesce("n_done", F.lit(0)).alias("n_done"),
            F.col("start.ts").alias("started_at"),
            F.col("start.operator").alias("operator"),
            F.least(
                F.col("complete.ts"),
                F.when(F.col("n_done") == target, F.col("last_done")),
            ).alias("ended_at"),
            "complete",
            "partial",
        )
        .withColumn("note", _last_note(F.col("complete"), F.col("partial"), F.col("ended_at")))
        .drop("complete", "partial")
        .withColumn(
            "state",
            F.when(F.col("ended_at").isNotNull(), "completed")
            .when(F.col("started_at").isNotNull(), "in-progress")
            .otherwise("pending"),
        )
    )


def _last_note(complete: Column, partial: Column, ended_at: Column) -> Column:
    """The later write of the first completion, if it ended the step, and the last partial one."""
    ended = F.when(complete["ts"] <= ended_at, complete)
    return F.greatest(ended, partial)["note"]


def phase_rejects(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events, or single indices of them, that change nothing, with a reason.

    One join of the raw events with the folded steps on (order, phase); the
    step side is unique per key, so a hot order is split by adaptive execution.
    """
    state = steps.select(
        "order_id",
        "phase",
        "n_articles",
        "started_at",
        "ended_at",
    )
    first = events.groupBy("order_id", "phase").agg(
        *[
            F.min(
                F.when(F.col("action") == action, F.struct("ts", "event_id"))
            ).alias(f"first_{action}")
            for action in (START, COMPLETE)
        ]
    )
    state = state.join(first, ["order_id", "phase"], "left")
    rows = events.select(
        "event_id",
        "order_id",
        "phase",
        "action",
        "ts",
        F.explode_outer(
            F.when(F.col("action") == COMPLETE_PARTIAL, F.col("article_indices"))
        ).alias("idx"),
    )
    at = F.struct("ts", "event_id")
    known = F.col("n_articles").isNotNull()
    reason = (
        F.when(
            (F.col("action") == COMPLETE_PARTIAL) & F.col("idx").isNull(), "no_articles"
        )
        .when(~known, "unknown_step")
        .when((F.col("action") == START) & (at > F.col("first_start")), "already_started")
        .when(
            (F.col("action") == COMPLETE)
            & ((at > F.col("first_complete")) | (F.col("ts") > F.col("ended_at"))),
            "already_completed",
        )
        .when(
            (F.col("action") == COMPLETE_PARTIAL)
            & ((F.col("idx") < 0) | (F.col("idx") >= F.col("n_articles"))),
            "index_out_of_range",
        )
    )
    return (
        rows.join(state, ["order_id", "phase"], "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("event_id", "order_id", "phase", "action", "idx", "reason")
    )


def fold_phase_events(
    events: DataFrame,
    articles: DataFrame,
    seeds: DataFrame | None = None,
    mode: str = "contract",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, article completions and rejects of an event log."""
    seeds = seed_steps(articles) if seeds is None else seeds
    marked = completions(events, articles)
    steps = fold_steps(seeds, events, marked, mode)
    return steps, known_completions(marked, seeds), phase_rejects(events, steps)


def order_progress(steps: DataFrame) -> DataFrame:
    """Completed and total steps, percent, and status of every order with steps.

    Completed phases come in step order (``seq``, then name).
    """
    ended = F.col("ended_at").isNotNull()
    seq = F.col("seq") if "seq" in steps.columns else F.lit(0)
    entry = F.struct(seq.alias("seq"), F.col("phase").alias("phase"))
    return (
        steps.groupBy("order_id")
        .agg(
            F.count("*").alias("n_steps"),
            F.count("ended_at").alias("n_completed"),
            F.max("ended_at").alias("last_end"),
            # At most one entry per phase of the order.
            F.transform(
                F.array_sort(F.collect_list(F.when(ended, entry))), lambda x: x["phase"]
            ).alias("completed_phases"),
        )
        .withColumn("all_completed", F.col("n_completed") == F.col("n_steps"))
        .withColumn("status", F.when(F.col("all_completed"), SHIPPED).otherwise(RECEIVED))
        .withColumn(
            "percent", F.floor(F.col("n_completed") * 100 / F.col("n_steps")).cast("long")
        )
    )


def order_status(orders: DataFrame, steps: DataFrame) -> DataFrame:
    """Orders with their status; an order without steps stays received."""
    shipped = (
        steps.groupBy("order_id")
        .agg(F.bool_and(F.col("ended_at").isNotNull()).alias("shipped"))
        .where("shipped")
    )
    return orders.join(shipped, "order_id", "left").withColumn(
        "status", F.when(F.col("shipped"), SHIPPED).otherwise(RECEIVED)
    ).drop("shipped")


def completion_notifications(steps: DataFrame) -> DataFrame:
    """Exactly one notification per completed order, dated by its last end."""
    return (
        steps.groupBy("order_id")
        .agg(
            F.count_if(F.col("ended_at").isNull()).alias("n_open"),
            F.min("started_at").alias("first_start"),
            F.max("ended_at").alias("created_at"),
        )
        .where(F.col("n_open") == 0)
        .select(
            "order_id",
            "created_at",
            F.lit(COMPLETED_MESSAGE).alias("message"),
            F.lit(False).alias("viewed"),
            seconds_between(F.col("first_start"), F.col("created_at")).alias("seconds"),
        )
    )


def phase_durations(steps: DataFrame) -> DataFrame:
    """Seconds and display text of every step that both started and ended."""
    seconds = seconds_between(F.col("started_at"), F.col("ended_at"))
    return (
        steps.where(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull())
        .withColumn("seconds", seconds)
        .withColumn("duration", duration_text(F.col("seconds")))
    )


def step_history(events: DataFrame, steps: DataFrame) -> DataFrame:
    """The event log with the state of the step just before each event."""
    before = (
        F.when(F.col("ended_at") < F.col("ts"), "completed")
        .when(F.col("started_at") < F.col("ts"), "in-progress")
        .otherwise("pending")
    )
    known = steps.select("order_id", "phase", "started_at", "ended_at")
    return events.join(known, ["order_id", "phase"]).select(
        "event_id", "order_id", "phase", "action", "operator", "ts", before.alias("state_before")
    )
