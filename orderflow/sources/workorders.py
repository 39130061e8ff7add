"""Work orders, articles and phase events read from the star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.operators.positions import with_position
from orderflow.schemas import COMPLETE, COMPLETE_PARTIAL, DEFAULT_PHASES, START


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_orders(spark: SparkSession, folder: str, client: bool = True) -> DataFrame:
    """One row per order; skip the customer join where no client is needed."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        "o_custkey",
        F.col("o_orderdate").alias("received"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due"),
        F.col("o_orderpriority").alias("priority"),
        F.lit(0).alias("estimate_minutes"),
    )
    if client:
        names = table(spark, folder, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("client")
        )
        orders = orders.join(names, "o_custkey", "left")
    return orders.drop("o_custkey")


def article_phases(returnflag: Column, linestatus: Column) -> Column:
    return F.array_compact(
        F.array(
            F.lit("LASER"),
            F.when(returnflag != "N", F.lit("PIEGA")),
            F.when(linestatus == "O", F.lit("SALDATURA")),
        )
    )


def work_articles(
    spark: SparkSession, folder: str, names: bool = False, only: DataFrame | None = None
) -> DataFrame:
    """One row per (order, idx). Line numbers repeat, so idx is a full ordering.

    The part join comes first: the numbering then leaves rows partitioned by
    order, which later per-order aggregations reuse. With ``only`` (a table of
    order ids) just the articles of these orders are read into the numbering.
    """
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
        article_phases(F.col("l_returnflag"), F.col("l_linestatus")).alias(
            "required_phases"
        ),
    )
    if names:
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_name").alias("name"),
            F.col("p_size").alias("size"),
        )
        lines = lines.join(parts, "l_partkey", "left")
    if only is not None:
        lines = lines.join(only.select("order_id"), "order_id", "left_semi")
    order = [
        F.col(c)
        for c in (
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_quantity",
            "l_extendedprice",
            "l_returnflag",
            "l_linestatus",
        )
    ]
    placed = with_position(lines, ["order_id"], order)
    return placed.select(
        "order_id",
        "idx",
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"),
        F.col("l_quantity").alias("qty"),
        "required_phases",
        F.col("l_partkey").alias("part_key"),
        *(["name", "size"] if names else []),
    )


def work_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Articles without their position, for sums and step seeding: no shuffle."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").alias("qty"),
        article_phases(F.col("l_returnflag"), F.col("l_linestatus")).alias(
            "required_phases"
        ),
    )


def phase_events(raw: DataFrame, phases: Sequence[str] = DEFAULT_PHASES) -> DataFrame:
    """Phase events from rows shaped like the ``events`` table; ``phases`` has three names."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = (
        F.when(F.col("event_type") == "view", START)
        .when(F.col("event_type") == "click", COMPLETE_PARTIAL)
        .when(F.col("event_type") == "purchase", COMPLETE)
    )
    return raw.where(F.col("event_type").isin("view", "click", "purchase")).select(
        "event_id",
        (F.col("user_id") * 10 + F.floor(k / 10)).alias("order_id"),
        F.get(F.array(*[F.lit(p) for p in phases]), k % 3).alias("phase"),
        action.alias("action"),
        F.when(action == COMPLETE_PARTIAL, F.array((k % 5).cast("int"))).alias(
            "article_indices"
        ),
        F.concat(F.lit("op"), (k % 7).cast("string")).alias("operator"),
        F.when(k % 4 != 3, F.concat(F.lit("nota "), k.cast("string"))).alias("note"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def work_events(spark: SparkSession, folder: str) -> DataFrame:
    return phase_events(table(spark, folder, "events"))
