"""Reports: archive, calendar, progress, cutting plan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.dates import duration_text, italian_day
from orderflow.operators.phases import phase_durations
from orderflow.operators.positions import with_position
from orderflow.schemas import SHIPPED

# Phases whose duration the archive shows, calendar grid size.
TIMED_PHASES = ["PIEGA", "SALDATURA"]
GRID_CELLS = 42
URGENT_DAYS = 3


def archive_report(
    orders: DataFrame, totals: DataFrame, steps: DataFrame, contains: str | None = None
) -> DataFrame:
    """Shipped orders with totals and the durations of the timed phases."""
    shipped = orders.where(F.col("status") == SHIPPED)
    if contains:
        shipped = shipped.where(F.contains(F.lower("client"), F.lit(contains.lower())))
    seconds = (
        phase_durations(steps.where(F.col("phase").isin(TIMED_PHASES)))
        .groupBy("order_id")
        .agg(
            *[
                F.max(F.when(F.col("phase") == p, F.col("seconds"))).alias(p.lower())
                for p in TIMED_PHASES
            ]
        )
    )
    report = shipped.join(totals, "order_id", "left").join(seconds, "order_id", "left")
    return report.select(
        "order_id",
        "client",
        italian_day(F.col("due")).alias("due_day"),
        F.coalesce("total_quantity", F.lit(0.0)).alias("total_quantity"),
        F.coalesce("n_articles", F.lit(0)).alias("n_articles"),
        *[
            F.coalesce(duration_text(F.col(p.lower())), F.lit("-")).alias(
                f"{p.lower()}_time"
            )
            for p in TIMED_PHASES
        ],
    )


def order_statistics(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """Number of orders, pieces and articles over a set of orders."""
    return orders.join(totals, "order_id", "left").agg(
        F.count("*").alias("n_orders"),
        F.coalesce(F.sum("total_quantity"), F.lit(0.0)).alias("pieces"),
        F.coalesce(F.sum("n_articles"), F.lit(0)).alias("n_articles"),
    )


def grid_start(month: str) -> date:
    """The Monday on or before the first day of ``month`` (yyyy-MM)."""
    first = date.fromisoformat(f"{month}-01")
    return first - timedelta(days=first.weekday())


def month_grid(spark: SparkSession, month: str, as_of: str) -> DataFrame:
    """The 42 days of a month sheet, with true dates for neighbouring months."""
    start = F.to_date(F.lit(grid_start(month).isoformat()))
    days = F.sequence(start, F.date_add(start, GRID_CELLS - 1))
    return (
        spark.range(1)
        .select(F.posexplode(days).alias("cell", "day"))
        .withColumn("cell", F.col("cell").cast("long"))
        .withColumn("other_month", F.date_format("day", "yyyy-MM") != month)
        .withColumn("is_today", F.col("day") == F.to_date(F.lit(as_of)))
    )


def due_in_grid(orders: DataFrame, month: str) -> DataFrame:
    """Orders not shipped whose due day lies on the month sheet."""
    start = grid_start(month)
    end = start + timedelta(days=GRID_CELLS)
    return orders.where(
        (F.col("status") != SHIPPED)
        & (F.col("due") >= F.lit(start))
        & (F.col("due") < F.lit(end))
    ).withColumn("day", F.col("due").cast("date"))


def calendar_entries(orders: DataFrame, month: str, as_of: str) -> DataFrame:
    """One row per open order on the sheet; the grid has 42 rows and is broadcast."""
    grid = month_grid(orders.sparkSession, month, as_of)
    return (
        due_in_grid(orders, month)
        .join(F.broadcast(grid), "day")
        .withColumn("label", F.substring("client", 1, 12))
    )


def calendar_month(orders: DataFrame, month: str, as_of: str) -> DataFrame:
    """The sheet with the number of open orders due on each day."""
    counts = (
        due_in_grid(orders, month).groupBy("day").agg(F.count("*").alias("n_orders"))
    )
    grid = month_grid(orders.sparkSession, month, as_of)
    return grid.join(counts, "day", "left").fillna(0, ["n_orders"])


def urgency(orders: DataFrame, as_of: str, days: int = URGENT_DAYS) -> DataFrame:
    """Days left to the due date and whether they are ``days`` or fewer."""
    left = F.datediff(F.col("due").cast("date"), F.to_date(F.lit(as_of)))
    return orders.withColumn("days_left", left.cast("long")).withColumn(
        "urgent", F.col("days_left") <= days
    )


def kanban_state(n_steps: Column, n_completed: Column, n_started: Column) -> Column:
    """Board column of an order.

    The thresholds are a choice of this library: nothing begun is
    ``not_started``; at least two thirds of the steps ended is
    ``almost_done``; an order without any step is ``blocked``.
    """
    return (
        F.when(n_steps == 0, "blocked")
        .when(n_completed == n_steps, "completed")
        .when(n_completed * 3 >= n_steps * 2, "almost_done")
        .when((n_completed > 0) | (n_started > 0), "in_progress")
        .otherwise("not_started")
    )


def kanban_board(orders: DataFrame, steps: DataFrame) -> DataFrame:
    counts = steps.groupBy("order_id").agg(
        F.count("*").alias("n_steps"),
        F.count("ended_at").alias("n_completed"),
        F.count("started_at").alias("n_started"),
    )
    return (
        orders.select("order_id")
        .join(counts, "order_id", "left")
        .fillna(0)
        .withColumn(
            "board",
            kanban_state(F.col("n_steps"), F.col("n_completed"), F.col("n_started")),
        )
        .groupBy("board")
        .agg(F.count("*").alias("n_orders"))
    )


def remaining_minutes(orders: DataFrame, steps: DataFrame, as_of: str) -> DataFrame:
    """Estimated minutes minus minutes already spent on ended or running steps.

    A choice of this library: running steps count up to ``as_of``; never below 0.
    """
    end = F.coalesce("ended_at", F.to_timestamp(F.lit(as_of)))
    spent = (
        steps.where(F.col("started_at").isNotNull())
        .select(
            "order_id",
            F.greatest(
                (F.unix_micros(end) - F.unix_micros("started_at")) / F.lit(6e7), F.lit(0.0)
            ).alias("minutes"),
        )
        .groupBy("order_id")
        .agg(F.sum("minutes").alias("spent"))
    )
    return orders.join(spent, "order_id", "left").withColumn(
        "remaining_minutes",
        F.greatest(
            F.col("estimate_minutes") - F.coalesce("spent", F.lit(0.0)), F.lit(0.0)
        ),
    )


def phase_performance(steps: DataFrame) -> DataFrame:
    """Ended steps and average seconds per phase and operator."""
    return (
        phase_durations(steps)
        .groupBy("phase", "operator")
        .agg(F.count("*").alias("n_steps"), F.avg("seconds").alias("avg_seconds"))
    )


def cutting_plan(
    articles: DataFrame, group: Sequence[str] = ("thickness",), **limits
) -> DataFrame:
    """Articles per sheet thickness, in cutting order by due date.

    There are few thicknesses and very many articles, so the sequence number
    comes from the piecewise numbering, not from one window per thickness.
    """
    order = [F.col("due"), F.col("order_id"), F.col("idx")]
    return with_position(articles, list(group), order, name="sequence", **limits)


def thickness_from_code(code: Column, prefixes: Sequence[tuple[str, float]]) -> Column:
    """Thickness by the longest matching code prefix."""
    ranked = sorted(prefixes, key=lambda p: -len(p[0]))
    chosen = F.lit(None).cast("double")
    for prefix, thickness in reversed(ranked):
        chosen = F.when(code.startswith(prefix), F.lit(float(thickness))).otherwise(chosen)
    return chosen


def thickness_from_name(name: Column) -> Column:
    """Thickness from a file name such as ``part_2.5mm.dxf``."""
    return F.regexp_extract(name, r"_(\d+(?:\.\d+)?)mm", 1).try_cast("double")
