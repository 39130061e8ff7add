"""Piecewise numbering of hot groups equals one window over each group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderflow.operators.positions import with_position
from orderflow.operators.reports import cutting_plan


def test_hot_groups_are_numbered_in_pieces(spark):
    # One order holds a third of all rows, with many ties in the leading key.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 97 + 100).alias("g"),
        (F.col("id") % 4).alias("a"),
        F.pmod(F.hash("id"), F.lit(1_000_000)).alias("b"),
        "id",
    )
    order = [F.col("a"), F.col("b"), F.col("id")]
    got = with_position(rows, ["g"], order, hot_rows=200, small_bytes=0)
    window = Window.partitionBy("g").orderBy(*order)
    want = rows.withColumn("idx", (F.row_number().over(window) - 1).cast("long"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("g = 7").count() == 1000


def test_small_or_even_inputs_take_one_window(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("g"), "id")
    for limits in ({}, {"small_bytes": 0}):
        plan = with_position(rows, ["g"], [F.col("id")], **limits)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Window") == 1 and "Union" not in text


def test_cutting_plan_with_hot_thickness(spark):
    rows = spark.range(600).select(
        (F.col("id") % 2).cast("double").alias("thickness"),
        F.date_add(F.lit("2026-01-01"), (F.col("id") % 5).cast("int")).alias("due"),
        F.col("id").alias("order_id"),
        F.lit(0).alias("idx"),
    )
    plain = cutting_plan(rows).collect()
    pieces = cutting_plan(rows, hot_rows=50, small_bytes=0).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, pieces))
