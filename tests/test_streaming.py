"""Streams over several batches end where a batch run does."""

import datetime as dt

from pyspark.sql import functions as F

from orderflow.operators import phases as P
from orderflow.plans import stream_queries
from orderflow.sources import workorders as W
from orderflow.streaming.expiry import write_fold_ttl
from orderflow.streaming.fold import compact_fold, current_steps, read_fold, write_fold
from orderflow.streaming.notifications import order_plans, stream_notifications
from orderflow.streaming.pickup import stream_corpus, stream_extraction

FOLDER = "/root/testdata/sf0.001"


def prepared(spark, path, parts=4):
    raw = W.table(spark, FOLDER, "events")
    for i in range(parts):
        part = raw.where(F.col("event_id") % parts == i)
        if i == 0:
            part = part.unionByName(part)  # repeated delivery
        part.coalesce(1).write.mode("append").parquet(str(path))
    return raw.schema


def stream(spark, path, schema):
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    return W.phase_events(raw)


def wanted(spark):
    articles = W.work_articles(spark, FOLDER)
    steps, _, _ = P.fold_phase_events(W.work_events(spark, FOLDER), articles)
    return articles, steps


def rows(df):
    return sorted(map(str, df.collect()))


def test_fold_over_batches(spark, tmp_path):
    schema = prepared(spark, tmp_path / "in")
    articles, steps = wanted(spark)
    # Parts are not in time order; no event is too late.
    for stateful in (False, True):
        base = tmp_path / f"out{stateful}"
        write_fold(
            stream(spark, tmp_path / "in", schema), f"{base}/fold", f"{base}/state",
            stateful=stateful,
        ).awaitTermination()
        fold = read_fold(spark, f"{base}/fold")
        assert fold.select("batch") if "batch" in fold.columns else True
        assert rows(current_steps(fold, articles)) == rows(steps)


def test_table_as_file_and_as_folder(spark, tmp_path):
    W.table(spark, FOLDER, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    counts = []
    for folder in (FOLDER, str(tmp_path)):
        query = stream_queries.event_stream(spark, folder).writeStream.format("memory")
        name = f"seen{len(counts)}"
        query.queryName(name).trigger(availableNow=True).start().awaitTermination()
        counts.append(spark.table(name).count())
    assert counts[0] == counts[1] > 0


def planned(spark, base, articles):
    out = []
    for name, plan in zip(("steps", "articles"), order_plans(articles), strict=True):
        plan.write.parquet(f"{base}/plan-{name}")
        out.append(spark.read.parquet(f"{base}/plan-{name}"))
    return out


def test_notifications_once(spark, tmp_path):
    """Over four batches and a restart: each completed order once, at its time."""
    schema = prepared(spark, tmp_path / "in")
    articles, steps = wanted(spark)
    plans = planned(spark, tmp_path, articles)
    for _ in range(2):  # the second run finds nothing new
        events = stream(spark, tmp_path / "in", schema)
        stream_notifications(events, *plans, f"{tmp_path}/notified", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/notified").select("order_id")
    want = P.completion_notifications(steps).select("order_id")
    assert rows(got) == rows(want) and rows(got)


def test_notifications_read_no_more_with_time(spark, tmp_path):
    """Twenty batches of equal size: rows read stay flat, and state of notified orders goes."""
    n = 20
    kinds = "event_id long, order_id long, phase string, action string, article_indices array<int>, operator string, note string, ts timestamp"
    articles = spark.createDataFrame([(o, i, ["LASER", "PIEGA"]) for o in range(n) for i in range(3)], "order_id long, idx long, required_phases array<string>")
    at = dt.datetime(2026, 1, 1)
    for b in range(n):  # batch b finishes order b
        log = [(b, b, "LASER", "complete", None, "x", None, at)] + [(100 + i, b, "PIEGA", "complete_partial", [i], "x", None, at + dt.timedelta(minutes=i)) for i in range(3)]
        spark.createDataFrame(log, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_notifications(events, *planned(spark, tmp_path, articles), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("order_id").distinct().count() == n
    assert {r["created_at"] for r in out.collect()} == {at + dt.timedelta(minutes=2)}
    assert {p["numInputRows"] for p in query.recentProgress} == {4}
    # One flag an order is what stays.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= n


def test_state_shrinks_and_late_events_count(spark, tmp_path):
    kinds = "event_id long, order_id long, phase string, action string, article_indices array<int>, operator string, note string, ts timestamp"
    at = lambda m: dt.datetime(2026, 1, 1, 8, m)
    batches = [
        [(i, i, "LASER", "complete", None, "b", f"n{i}", at(30)) for i in range(50)] + [(99, 77, "LASER", "start", None, "a", None, at(1))],
        [(200, 0, "LASER", "start", None, "late", None, at(5)), (201, 0, "LASER", "complete", None, "b", "first", at(10))],
        [(300, 1, "LASER", "start", None, "late", None, at(6))],
    ]
    for b in batches:
        spark.createDataFrame(b, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sizes = {}
    for keep in (0, 3_600_000):
        query = write_fold_ttl(events, f"{tmp_path}/fold{keep}", f"{tmp_path}/state{keep}", keep_ms=keep)
        query.awaitTermination()
        sizes[keep] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 1 <= sizes[0] < 10 < 51 <= sizes[3_600_000]  # keys that were only started stay
    articles = spark.createDataFrame([(o, 0, ["LASER"]) for o in range(80)], "order_id long, idx long, required_phases array<string>")
    log = [e for b in batches for e in b]
    want = P.fold_phase_events(spark.createDataFrame(log, kinds), articles)[0]
    for keep in sizes:
        assert rows(current_steps(read_fold(spark, f"{tmp_path}/fold{keep}"), articles)) == rows(want)


def test_one_call_serves_many_orders(spark, tmp_path):
    """Calls of the processor, one entry each in the plan's metrics, do not grow with the orders; all entries end by one timer."""
    kinds = "event_id long, order_id long, phase string, action string, article_indices array<int>, operator string, note string, ts timestamp"
    at = lambda m: dt.datetime(2026, 1, 1, 8, m)
    n = 700
    batches = [
        [(i, i, "LASER", "start", None, f"op{i}", None, at(20)) for i in range(n)] + [(5000, None, "LASER", "start", None, "x", None, at(20)), (5001, -3, "LASER", "start", None, "x", None, at(20))],
        [(1000 + i, i, "LASER", "complete", None, None, f"n{i}", at(30)) for i in range(n)] + [(6000 + i, i, "LASER", "start", None, "late", None, at(10)) for i in range(0, n, 2)],
        [(9000, 3, "LASER", "complete", None, None, "early", at(25))],
        [(9001, 4, "LASER", "complete", None, None, "early", at(24))],
    ]
    for b in batches:
        spark.createDataFrame(b, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    articles = spark.createDataFrame([(o, 0, ["LASER"]) for o in range(n)], "order_id long, idx long, required_phases array<string>")
    want = rows(P.fold_phase_events(spark.createDataFrame([e for b in batches for e in b], kinds), articles)[0])
    for keep in (0, 1, 3_600_000):
        query = write_fold_ttl(events, f"{tmp_path}/fold{keep}", f"{tmp_path}/state{keep}", keep_ms=keep)
        query.awaitTermination()
        last = query.recentProgress[-1]["stateOperators"][0]
        kept = last["numRowsTotal"]
        assert kept < 20 if keep < 10 else kept >= n
        assert sum(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress) < 20
        assert rows(current_steps(read_fold(spark, f"{tmp_path}/fold{keep}"), articles)) == want


def test_late_stream_is_split_into_files(spark, tmp_path, monkeypatch):
    """A third of the events is several files, still one batch, and all events are there."""
    monkeypatch.setattr(stream_queries, "EVENTS_PER_FILE", 100)
    raw = W.table(spark, FOLDER, "events")
    late = stream_queries._late_stream(spark, FOLDER, str(tmp_path))
    assert len(list((tmp_path / "in").glob("*.parquet"))) >= 3 * (raw.count() // 300)
    query = late.writeStream.format("memory").queryName("late_files").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert rows(spark.table("late_files")) == rows(W.work_events(spark, FOLDER))


def test_compaction_keeps_the_fold(spark, tmp_path):
    schema = prepared(spark, tmp_path / "in", parts=6)
    articles, steps = wanted(spark)
    for every in (2, 4):
        base = f"{tmp_path}/every{every}"
        write_fold(stream(spark, tmp_path / "in", schema), f"{base}/fold", f"{base}/state", compact_every=every).awaitTermination()
        assert len(list((tmp_path / f"every{every}" / "fold").glob("batch=*"))) <= every + 1
        assert rows(current_steps(read_fold(spark, f"{base}/fold"), articles)) == rows(steps)
        compact_fold(spark, f"{base}/fold", 100)
        compact_fold(spark, f"{base}/fold", 100)
        assert [f.name for f in (tmp_path / f"every{every}" / "fold").glob("batch=*")] == ["batch=-100"]
        assert rows(current_steps(read_fold(spark, f"{base}/fold"), articles)) == rows(steps)


def test_pickup_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    text = "DIVISIONE CUCINE\nORDINE N. 300 000 946\n1AVAR0000000012---- NR 5SMALL\n"

    def run():
        docs = stream_corpus(spark, str(inbox), files_per_trigger=1)
        stream_extraction(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return [
            spark.read.parquet(str(tmp_path / "out" / k)).count() for k in ("accepted", "rejected")
        ]

    (inbox / "a.txt").write_text(text)
    (inbox / "b.TXT").write_text("appunto")
    assert run() == [1, 1]
    (inbox / "c.txt").write_text(text)
    assert run() == [2, 1]


def test_pickup_files_do_not_grow(spark, tmp_path, monkeypatch):
    """More text is more files of an eighth, not longer ones; no text is lost, odd ids and texts included."""
    monkeypatch.setattr(stream_queries, "FILE_BYTES", 2_000)
    monkeypatch.setattr(stream_queries, "_new_folder", lambda spark: f"{tmp_path}/run")
    docs = [(i, f"é{i}\n" * (i % 50)) for i in range(800)] + [(8, None), (8, "x" * 500), (8, "x" * 500), (-3, "neg"), (None, "none")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want: dict = {}
    for i, text in docs:
        eighth = None if i is None else i % 8 if i >= 0 else -(-i % 8)
        want[eighth] = want.get(eighth, 0) + len(text or "") + 1
    assert {r.eighth: r.n_chars for r in stream_queries.stream_pickup(spark, str(tmp_path)).collect()} == want
    sizes = [f.stat().st_size for f in (tmp_path / "run" / "in").rglob("*.txt")]
    assert max(sizes) < 6_000 < sum(sizes) / 10
    assert len(list((tmp_path / "run" / "out").glob("batch=*"))) <= 6
