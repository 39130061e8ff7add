"""One notification per completed order, also across restarts, from keyed state.

The state of an order holds its steps and its marked articles in map states of
the state store, one entry each, so a batch reads what its events name and
nothing else: no log of earlier batches is read, and none is kept. When the last
step ends the notification is emitted, the entries go, and one flag stays that
keeps it from being sent again.

The order's plan (which steps, how many articles) joins the events as a static
table, see ``order_plans``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orderflow.functions.dates import seconds_between
from orderflow.operators.phases import _check, seed_steps
from orderflow.schemas import COMPLETE, COMPLETE_PARTIAL, COMPLETED_MESSAGE, START
from orderflow.streaming.expiry import with_rocksdb
from orderflow.streaming.fold import _run

COMPLETED = "order_id bigint, first_start bigint, created_at bigint"


def order_plans(articles: DataFrame, mode: str = "contract") -> tuple[DataFrame, DataFrame]:
    """(order_id, steps) with the articles each step waits for, and (order_id, idx, required_phases).

    Write both down before a stream starts, as every batch joins them.
    """
    _check(mode)
    target = F.col("n_required" if mode == "contract" else "n_articles").alias("target")
    steps = seed_steps(articles).groupBy("order_id").agg(F.collect_list(F.struct("phase", target)).alias("steps"))
    return steps, articles.select("order_id", F.col("idx").cast("int").alias("idx"), "required_phases")


class OrderCompletion(StatefulProcessor):
    """Steps of one order until all have ended; times in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "sent boolean")
        self.steps = handle.getMapState("steps", "phase string", "start long, complete long, n_done long, last_done long")
        self.done = handle.getMapState("done", "phase string, idx int", "ts long")

    def _step(self, phase: str) -> tuple:
        if phase not in self.met:
            self.met[phase] = tuple(self.steps.getValue((phase,)) or (None, None, 0, None))
        return self.met[phase]

    def _set(self, phase: str, step: tuple) -> None:
        self.met[phase] = step
        self.changed.add(phase)

    def _mark(self, phase: str, idx: int, ts) -> None:
        start, complete, n, last = self._step(phase)
        key = (phase, idx)
        if key not in self.marks:
            self.marks[key] = self.done.getValue(key)
        old = self.marks[key]
        if old is None:
            n, last = n + 1, ts if last is None else max(last, ts)
        elif ts < old[0]:
            # An earlier completion came late: the last one of the step may move.
            kept = {tuple(k): v[0] for k, v in self.done.iterator()} | {k: v[0] for k, v in self.marks.items() if v} | {key: ts}
            last = max(v for k, v in kept.items() if k[0] == phase)
        else:
            return
        self.marks[key] = (ts,)
        self._set(phase, (start, complete, n, last))

    def _keep(self) -> None:
        for phase in self.changed:
            self.steps.updateValue((phase,), self.met[phase])
        for key, mark in self.marks.items():
            self.done.updateValue(key, tuple(mark))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.sent.exists():
            return
        # Entries are read once and written once for all rows of a call: each is a round trip to the JVM.
        self.met, self.changed, self.marks = {}, set(), {}
        plan = None
        for r in rows:
            plan = r.steps
            if r.action == COMPLETE_PARTIAL:
                if r.counts:
                    self._mark(r.phase, r.idx, r.ts)
                continue
            start, complete, n, last = self._step(r.phase)
            if r.action == START:
                start = r.ts if start is None else min(start, r.ts)
            else:
                complete = r.ts if complete is None else min(complete, r.ts)
            self._set(r.phase, (start, complete, n, last))
        if not plan:
            self._keep()
            return
        ends, starts = [], []
        for entry in plan:
            phase, target = entry["phase"], entry["target"]
            start, complete, n, last = self._step(phase)
            ends.append(min((x for x in (complete, last if n == target else None) if x is not None), default=None))
            starts.append(start)
        if any(end is None for end in ends):
            self._keep()
            return
        self.sent.update((True,))
        self.steps.clear()
        self.done.clear()
        yield Row(order_id=key[0], first_start=min((s for s in starts if s is not None), default=None), created_at=max(ends))

    def close(self) -> None:
        pass


def stream_notifications(
    events: DataFrame,
    steps: DataFrame,
    articles: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "contract",
    every: str | None = None,
) -> StreamingQuery:
    """Write the notifications of each batch below ``path``; ``steps`` and ``articles`` as of ``order_plans``.

    Events of orders without a plan, of phases without a step and of articles
    outside the list change nothing, as in the batch fold.
    """
    _check(mode)
    rows = events.select(
        "order_id", "phase", "action", F.unix_micros("ts").alias("ts"),
        F.explode_outer(F.when(F.col("action") == COMPLETE_PARTIAL, F.col("article_indices"))).alias("idx"),
    )
    known = rows.join(steps, "order_id").join(articles, ["order_id", "idx"], "left")
    counts = F.col("required_phases").isNotNull()
    if mode == "contract":
        counts = counts & F.array_contains("required_phases", F.col("phase"))
    known = known.where(F.exists("steps", lambda s: s["phase"] == F.col("phase")))
    known = known.select("order_id", "phase", "action", "ts", "idx", F.coalesce(counts, F.lit(False)).alias("counts"), "steps")
    found = known.groupBy("order_id").transformWithState(OrderCompletion(), COMPLETED, "update", "none")

    def write(batch: DataFrame, batch_id: int) -> None:
        times = {c: F.timestamp_micros(c) for c in ("first_start", "created_at")}
        rows = batch.withColumns(times).select(
            "order_id",
            "created_at",
            F.lit(COMPLETED_MESSAGE).alias("message"),
            F.lit(False).alias("viewed"),
            seconds_between(F.col("first_start"), F.col("created_at")).alias("seconds"),
        )
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return with_rocksdb(events.sparkSession, lambda: _run(found, write, checkpoint, "update", every), every)
