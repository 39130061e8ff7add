"""Exact positions inside groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.session import checkpoint_dir, input_bytes

# An input up to this size cannot hold a group too large for one task.
SMALL_INPUT_BYTES = 256 * 1024 * 1024
# Largest group that one task numbers on its own.
HOT_ROWS = 5_000_000


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "idx",
    hot_rows: int | None = None,
    small_bytes: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 in the given total order.

    Ordinary groups are numbered by one window. Groups above ``hot_rows`` are
    range-partitioned on (group, order) and numbered piece by piece, each
    piece starting where the pieces before it end, so no task ever holds more
    than one piece. Small inputs skip the check. Group keys must not be NULL.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    small_bytes = SMALL_INPUT_BYTES if small_bytes is None else small_bytes
    window = Window.partitionBy(*group).orderBy(*order)
    plain = df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    size = input_bytes(df)
    if size is not None and size <= small_bytes:
        return plain

    sizes = df.groupBy(*group).count().where(F.col("count") > hot_rows)
    total = sizes.agg(F.sum("count").alias("rows")).first()["rows"]
    if not total:
        return plain

    # Spark broadcasts these small tables below its own size threshold only.
    hot_keys = sizes.select(*group)
    cold = df.join(hot_keys, list(group), "left_anti").withColumn(
        name, (F.row_number().over(window) - 1).cast("long")
    )
    hot = df.join(hot_keys, list(group), "left_semi")
    pieces = max(2, math.ceil(total / hot_rows) * 2)

    # The sampled range bounds must not change between the two uses below,
    # also when executors are lost: write the pieces down once.
    checkpoint_dir(df.sparkSession)
    placed = (
        hot.repartitionByRange(pieces, *[F.col(g) for g in group], *order)
        .withColumn("_piece", F.spark_partition_id())
        .checkpoint()
    )
    before = (
        Window.partitionBy(*group)
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy(*group, "_piece")
        .count()
        .withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy(*group, "_piece").orderBy(*order)
    numbered = (
        placed.join(starts, [*group, "_piece"])
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_piece", "_start")
    )
    return cold.unionByName(numbered.select(*cold.columns))
