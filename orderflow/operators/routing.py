"""Routing: which phase each article needs next, and what waits at a station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.operators.phases import _check


_STEP = "array<struct<seq:int,phase:string>>"


def _in_step_order(entries: Column) -> Column:
    """Phases by the place of their step in the order, then by name."""
    return F.transform(F.array_sort(F.array_distinct(entries)), lambda x: x["phase"])


def _step(df: DataFrame) -> Column:
    seq = F.col("seq").cast("int") if "seq" in df.columns else F.lit(0)
    return F.struct(seq.alias("seq"), F.col("phase").alias("phase"))


def completed_by_article(done: DataFrame) -> DataFrame:
    """Completed steps per (order, idx), with their place; at most one entry per phase."""
    return done.groupBy("order_id", "idx").agg(F.collect_set(_step(done)).alias("_done"))


def next_phase(required: Column, finished: Column) -> Column:
    """First required phase that is not finished; NULL when all are."""
    return F.get(
        F.filter(required, lambda p: ~F.array_contains(finished, p)), F.lit(0)
    )


def article_states(
    articles: DataFrame, done: DataFrame, steps: DataFrame, mode: str = "contract"
) -> DataFrame:
    """Articles with completed phases, next phase and ``is_done``.

    Completed phases come in the order of the article's own list; phases it was
    marked for without requiring them follow in step order. In ``contract`` mode a
    phase that ended for the order is finished for all its articles. Both joined
    sides are unique per key.
    """
    _check(mode)
    nothing = F.array().cast(_STEP)
    states = articles.join(completed_by_article(done), ["order_id", "idx"], "left")
    finished = F.coalesce("_done", nothing)
    if mode == "contract":
        ended = (
            steps.where(F.col("ended_at").isNotNull())
            .groupBy("order_id")
            .agg(F.collect_set(_step(steps)).alias("_ended"))
        )
        states = states.join(ended, "order_id", "left")
        over = F.filter(
            F.coalesce("_ended", nothing), lambda x: F.array_contains("required_phases", x["phase"])
        )
        finished = F.concat(finished, over)
    names = _in_step_order(finished)
    states = states.withColumn(
        "completed_phases",
        F.array_union(
            F.array_intersect(F.coalesce("required_phases", F.array().cast("array<string>")), names),
            names,
        ),
    )
    return (
        states.withColumn(
            "next_phase", next_phase(F.col("required_phases"), F.col("completed_phases"))
        )
        .withColumn("is_done", F.col("next_phase").isNull())
        .drop("_done", "_ended")
    )


def phase_badges(states: DataFrame) -> DataFrame:
    """One row per (article, required phase): completed, next or pending."""
    state = (
        F.when(F.array_contains("completed_phases", F.col("phase")), "completed")
        .when(F.col("phase") == F.col("next_phase"), "next")
        .otherwise("pending")
    )
    return states.select(
        "order_id",
        "idx",
        "completed_phases",
        "next_phase",
        F.posexplode("required_phases").alias("seq", "phase"),
    ).select("order_id", "idx", "seq", "phase", state.alias("badge"))


def open_orders(steps: DataFrame, phase: str) -> DataFrame:
    """Orders whose step for the phase has not ended."""
    return steps.where((F.col("phase") == phase) & F.col("ended_at").isNull()).select(
        "order_id"
    )


def waiting_articles(
    states: DataFrame, steps: DataFrame, phase: str, mode: str = "contract"
) -> DataFrame:
    """Articles whose next phase is the given one, in orders still open for it.

    In ``contract`` mode an ended phase is never next, so the semi join on
    open steps would keep every row and is left out.
    """
    _check(mode)
    waiting = states.where(F.col("next_phase") == phase)
    if mode == "code":
        waiting = waiting.join(open_orders(steps, phase), "order_id", "left_semi")
    return waiting


def station_queue(
    orders: DataFrame,
    states: DataFrame,
    steps: DataFrame,
    phase: str,
    mode: str = "contract",
) -> DataFrame:
    """Orders waiting at a station with their waiting articles and pieces.

    Articles are added up per order before orders are joined, so the join is
    one row to one row.
    """
    per_order = (
        waiting_articles(states, steps, phase, mode)
        .groupBy("order_id")
        .agg(F.count("*").alias("n_articles"), F.sum("qty").alias("pieces"))
    )
    return orders.join(per_order, "order_id").select(
        "order_id", "client", "due", "n_articles", "pieces"
    )


def station_summary(states: DataFrame) -> DataFrame:
    """Orders, articles and pieces waiting per phase.

    Counted per (phase, order) first: distinct orders then need no set.
    """
    return (
        states.where(F.col("next_phase").isNotNull())
        .groupBy(F.col("next_phase").alias("phase"), "order_id")
        .agg(F.count("*").alias("articles"), F.sum("qty").alias("qty"))
        .groupBy("phase")
        .agg(
            F.count("*").alias("n_orders"),
            F.sum("articles").alias("n_articles"),
            F.sum("qty").alias("pieces"),
        )
    )


def remaining_articles(articles: DataFrame, done: DataFrame, phase: str) -> DataFrame:
    """Articles not yet marked for a phase: what "complete all" would select."""
    marked = done.where(F.col("phase") == phase).select("order_id", "idx")
    return articles.join(marked, ["order_id", "idx"], "left_anti")


def inherit_phases(articles: DataFrame, orders: DataFrame) -> DataFrame:
    """Give articles without phases the phase list of their order."""
    own = orders.select("order_id", F.col("required_phases").alias("_order_phases"))
    return (
        articles.join(own, "order_id", "left")
        .withColumn(
            "required_phases",
            F.when(
                F.coalesce(F.size("required_phases"), F.lit(0)) > 0,
                F.col("required_phases"),
            ).otherwise(F.col("_order_phases")),
        )
        .drop("_order_phases")
    )
