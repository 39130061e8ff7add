"""Fold of a stream whose state ends: finished keys leave the state store.

State is kept by (order, phase, article index), as in ``fold``. A key is finished
once its completion has been seen; ``keep_ms`` of processing time after its last
event a timer removes it. Nothing is lost by that: every change was written to
the log as a whole register, and a late event starts a register of its own which
the reader merges (all fields are minima, or a maximum for the last note). Keys
that were only started stay, so the state grows with open work, not with all
work ever done.

A call of the processor costs far more than a row, so it serves a block of orders
for one phase and article index, with an entry of its map state for each order. A
hot order thus still spreads over as many keys as it has phases and indices. Rows
are read one after another, so a call holds one register for each order of its
block, however many rows there are; its rows of a batch meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orderflow.streaming.fold import KEY, _marks, _run, as_log

# A register as flat columns. Times are whole microseconds: exact, and free of time zones in Python.
WRITES = {"start": "operator", "complete": "note", "partial": "note"}
STATE = ", ".join(f"{w}_ts bigint, {w}_id bigint, {w}_value string" for w in WRITES) + ", done_ts bigint"
REGISTER = "order_id bigint, phase string, idx int, " + STATE
NAMES = [c.split()[0] for c in REGISTER.split(", ")]
EMPTY = (None,) * 10
# A block is 2 ** BLOCK_BITS orders of following ids.
BLOCK_BITS = 10
# So many orders of a block are looked up one by one.
FEW = 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(a: tuple, b: tuple) -> tuple:
    """Two registers as one: the first start, the first completion, the last partial write.

    Equal times go to the lower event id among first writes, to the higher among last.
    """
    out: list = []
    for k, pick in ((0, min), (3, min), (6, max)):
        writes = [x[k : k + 3] for x in (a, b) if x[k] is not None]
        out += pick(writes, key=lambda w: w[:2]) if writes else (None,) * 3
    return (*out, min((x[9] for x in (a, b) if x[9] is not None), default=None))


class StepRegisters(StatefulProcessor):
    """A register per order of the block, merged with what arrives, dropped when finished and quiet."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.registers = handle.getMapState("registers", "order_id bigint", f"{STATE}, due bigint")

    def _before(self, orders) -> dict:
        """Registers of these orders as kept: one by one if they are few, else by one scan of the block."""
        if len(orders) > FEW:
            return {tuple(k)[0]: tuple(v)[:10] for k, v in self.registers.iterator()}
        found = {order: self.registers.getValue((order,)) for order in orders}
        return {order: tuple(v)[:10] for order, v in found.items() if v is not None}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict = {}
        for r in rows:
            order = r.order_id
            arrived[order] = merged(arrived.get(order, EMPTY), tuple(r)[4:])
        kept = self._before(arrived)
        due = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
        row, ends = Row(*NAMES), False
        # Every call on the state is a round trip to the JVM, so only what changes is written.
        for order, register in arrived.items():
            before = kept.get(order)
            if before is not None:
                register = merged(before, register)
            finished = register[3] is not None or register[9] is not None
            if finished and self.keep_ms <= 0:
                if before is not None:
                    self.registers.removeKey((order,))
            elif finished or register != before:
                self.registers.updateValue((order,), (*register, due if finished else None))
                ends = ends or finished
            yield row(order, *key[1:], *register)
        # One timer is enough: when it fires it is set to what ends next.
        if ends and next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        ends = [(tuple(v)[10], tuple(k)) for k, v in self.registers.iterator() if tuple(v)[10] is not None]
        for due, order in ends:
            if due <= now:
                self.registers.removeKey(order)
        later = min((due for due, _ in ends if due > now), default=None)
        if later is not None:
            self.handle.registerTimer(later)
        return iter(())

    def close(self) -> None:
        pass


def _flat(marks: DataFrame) -> DataFrame:
    columns = [
        c
        for w, value in WRITES.items()
        for c in (F.unix_micros(f"{w}.ts").alias(f"{w}_ts"), F.col(f"{w}.event_id").alias(f"{w}_id"), F.col(f"{w}.{value}").alias(f"{w}_value"))
    ]
    return marks.select(*KEY, *columns, F.unix_micros("done_ts").alias("done_ts"))


def _nested(registers: DataFrame) -> DataFrame:
    writes = [
        F.when(
            F.col(f"{w}_ts").isNotNull(),
            F.struct(F.timestamp_micros(f"{w}_ts").alias("ts"), F.col(f"{w}_id").alias("event_id"), F.col(f"{w}_value").alias(value)),
        ).alias(w)
        for w, value in WRITES.items()
    ]
    return registers.select(*KEY, *writes, F.timestamp_micros("done_ts").alias("done_ts"))


def with_rocksdb(spark, start, every: str | None = None):
    """Start a query on the state store that keyed processors need; other queries keep theirs.

    A query that drains what is available runs no batches without data: timers
    would ask for one more for ever, and fire with the next data just as well.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if every is None:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write_fold_ttl(
    events: DataFrame, path: str, checkpoint: str, keep_ms: int = 3_600_000, every: str | None = None
) -> StreamingQuery:
    """As ``write_fold`` with state, but with state that ends; read it with ``read_fold``."""
    marks = _flat(_marks(events))
    blocks = marks.select(F.shiftright("order_id", BLOCK_BITS).alias("block"), *marks.columns)
    registers = blocks.groupBy("block", *KEY[1:]).transformWithState(
        StepRegisters(keep_ms), REGISTER, "update", "processingTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        as_log(_nested(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return with_rocksdb(events.sparkSession, lambda: _run(registers, write, checkpoint, "update", every), every)
