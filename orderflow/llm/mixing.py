"""Mixing sources to target weights by a proportionate-fair schedule of blocks.

Each source's rows, in the order of a hash of their key, form blocks. In a
schedule of one block a slot, block k of a source with weight w (of a sum of 1)
is released at slot floor(k / w) and due at ceil((k + 1) / w). Earliest deadline
first keeps every source, at every slot, less than one block from its weight.
Weights are exact: floats count as the fractions they are.

When a source runs out, the weights of the others are scaled up and a new phase
begins: no row is dropped. Sources without a target follow after the others,
in proportion to their rows.

Null sources are a source of their own and null keys rows like others; empty
tables give no rows; equal rows get places of their own. DataFrame operations
only. The driver holds a few numbers for each source and ``SLOTS`` slots at a
time; the places of the blocks are a table that rows are joined with.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents

BLOCK_ROWS = 16
#: Slots that the driver holds at a time.
SLOTS = 1 << 18
#: Rows of a source that one task numbers at a time, about.
BUCKET_ROWS = 100_000


def exact_shares(weights: dict) -> dict:
    """Whole numbers in the very proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def whole_shares(weights: dict, period: int) -> dict:
    """Shares of a period in whole slots, one at least, by largest remainder."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    shares = {s: 1 + math.floor(x) for s, x in exact.items()}
    by_rest = sorted(weights, key=lambda s: (math.floor(exact[s]) - exact[s], s is None, str(s)))
    for s in by_rest[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def earliest_deadline_first(shares: dict) -> Iterator:
    """The source of each slot, without end: earliest deadline first among released blocks."""
    total = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, str(s)))
    share, done = [shares[s] for s in names], [0] * len(names)
    waiting = [(0, i) for i in range(len(names))]  # by release
    ready: list = []  # by deadline
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // share[i]), i))
        _, i = heapq.heappop(ready)
        yield names[i]
        done[i] += 1
        heapq.heappush(waiting, (done[i] * total // share[i], i))


def one_period(shares: dict) -> dict[object, list[int]]:
    """The slots of each source in as many slots as there are shares."""
    slots: dict[object, list[int]] = {s: [] for s in shares}
    for t, s in enumerate(itertools.islice(earliest_deadline_first(shares), sum(shares.values()))):
        slots[s].append(t)
    return slots


def schedule(blocks: dict, weights: dict, period: int | None = None) -> Iterator[tuple]:
    """(source, block) of each slot."""
    left, done = dict(blocks), dict.fromkeys(blocks, 0)
    while alive := [s for s in left if left[s]]:
        goal = {s: weights[s] for s in alive if (weights.get(s) or 0) > 0} or {s: left[s] for s in alive}
        for s in earliest_deadline_first(whole_shares(goal, period) if period else exact_shares(goal)):
            if not left[s]:  # the phase ends where a source would need a block that it has not
                break
            yield s, done[s]
            done[s] += 1
            left[s] -= 1


def _places(spark: SparkSession, plan: Iterator[tuple], numbers: dict, counts: dict, block_rows: int) -> DataFrame:
    """_s (number of the source), _nth (block), _when (slot) and _start (position of its first row) of all blocks."""
    kinds, scratch, chunk = "_s int, _nth long, _when long, _start long", None, None
    rows = np.array(list(counts.values()), np.int64)
    slot, start = 0, 0
    while held := list(itertools.islice(plan, SLOTS)):
        if chunk is not None:
            scratch = scratch or Scratch(spark, "mixing")
            scratch.keep(chunk, f"places/{slot}")
        s, nth = np.array([numbers[x] for x, _ in held], np.int32), np.array([k for _, k in held], np.int64)
        # Only the last block of a source may be short.
        ends = start + np.cumsum(np.minimum(block_rows, rows[s] - nth * block_rows))
        columns = [s, nth, slot + np.arange(len(s)), np.r_[start, ends[:-1]]]
        chunk = spark.createDataFrame(pa.table([pa.array(x) for x in columns], ["_s", "_nth", "_when", "_start"]), kinds)
        slot, start = slot + len(s), int(ends[-1])
    if scratch is None:
        return spark.createDataFrame([], kinds) if chunk is None else chunk
    scratch.keep(chunk, f"places/{slot}")
    return spark.read.schema(kinds).parquet(f"{scratch.folder}/places/*")


def _order(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def mix(
    docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, key: str = "doc_id", source: str = "source"
) -> DataFrame:
    """All rows with block, slot and position (0-based place in the mixture).

    ``weights``: target weight of each source; if none, the square root of its
    rows. ``period``: if given, weights are rounded to whole slots of a schedule
    that repeats after so many. The new columns are added to all columns of the
    input, under other names (with leading underscores) if the input has such
    columns.
    """
    spark = docs.sparkSession
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(f"`{source}`").alias("s")).agg(F.count("*").alias("n")).collect()}
    numbers = {s: i for i, s in enumerate(counts)}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    plan = schedule(blocks, {s: math.sqrt(n) for s, n in counts.items()} if weights is None else weights, period)
    places = _places(spark, plan, numbers, counts, block_rows)
    sources = spark.createDataFrame(list(numbers.items()), f"_name {docs.schema[source].dataType.simpleString()}, _number int")

    names = {}
    for n in ("block", "slot", "position"):
        names[n] = n
        while names[n] in docs.columns:
            names[n] = "_" + names[n]
    # Rows of a source in hash order: numbered within ranges of the hash, each
    # after the rows of the ranges before it, so no source is gathered.
    digits = max(1, math.ceil(math.log(max(1, max(counts.values(), default=1) / BUCKET_ROWS), 16)) + 1)
    rows = docs.withColumn("_md5", _order(F.col(f"`{key}`"))).withColumn("_range", F.substring("_md5", 1, digits))
    sizes = rows.groupBy(F.col(f"`{source}`").alias("_of"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_of").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_of", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    starts = starts.join(sources, F.col("_of").eqNullSafe(F.col("_name"))).drop("_name")
    within = Window.partitionBy(f"`{source}`", "_range").orderBy("_md5", f"`{key}`")
    rows = rows.withColumn("_in", F.row_number().over(within) - 1)
    rows = rows.join(starts, F.col(f"`{source}`").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_r")))
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_in")).withColumn("_at", F.floor(F.col("_rank") / block_rows))
    rows = rows.join(places, (F.col("_number") == F.col("_s")) & (F.col("_at") == F.col("_nth")))
    place = F.col("_start") + F.col("_rank") % block_rows
    added = {names["block"]: F.col("_nth"), names["slot"]: F.col("_when"), names["position"]: place.cast("long")}
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(name) for name, x in added.items()])


def in_order(mixed: DataFrame, n: int, parts: int, position: str = "position") -> DataFrame:
    """Deal the n rows of ``mix`` to consecutive parts by position, each part sorted."""
    part = F.floor(F.col(position) * parts / max(1, n)).cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions(position)


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix(docs)
