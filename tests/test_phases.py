"""Phase lifecycle on small hand-checked orders, and properties of the fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import orders as O
from orderflow.operators import phases as P
from orderflow.operators import routing as Q

EVENT = (
    "event_id long, order_id long, phase string, action string, article_indices array<int>, "
    "operator string, note string, ts timestamp"
)
ARTICLE = "order_id long, idx long, code string, qty double, required_phases array<string>"
T0 = dt.datetime(2026, 1, 1, 8)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def event(i, phase, action, minute, idx=None, operator="op", order=1, note=None):
    return (i, order, phase, action, idx, operator, note, at(minute))


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(
        [
            (1, 0, "SA", 50.0, ["LASER", "PIEGA", "SALDATURA"]),
            (1, 1, "BB", 100.0, ["LASER", "SALDATURA"]),
        ],
        ARTICLE,
    )


def run(spark, articles, events, mode="contract"):
    df = spark.createDataFrame(events, EVENT)
    steps, done, rejects = P.fold_phase_events(df, articles, mode=mode)
    states = Q.article_states(articles, done, steps, mode)
    return (
        {r.phase: r for r in steps.collect()},
        {r.idx: r for r in states.collect()},
        {(r.event_id, r.idx): r.reason for r in rejects.collect()},
        steps,
        states,
    )


def test_lifecycle(spark, articles):
    """Whole phases one after the other, as the order guide walks through it."""
    _, states, _, _, _ = run(spark, articles, [event(1, "LASER", "start", 0)])
    assert [states[i].next_phase for i in (0, 1)] == ["LASER", "LASER"]
    log = [event(1, "LASER", "start", 0), event(2, "LASER", "complete", 5)]
    _, states, _, steps, frame = run(spark, articles, log)
    assert [states[i].next_phase for i in (0, 1)] == ["PIEGA", "SALDATURA"]
    waiting = Q.waiting_articles(frame, steps, "PIEGA").collect()
    assert [r.code for r in waiting] == ["SA"]
    log += [event(3, "PIEGA", "complete", 6), event(4, "SALDATURA", "complete", 9)]
    steps, states, _, frame, _ = run(spark, articles, log)
    assert all(s.is_done for s in states.values())
    progress = P.order_progress(frame).first()
    assert (progress.status, progress.percent, progress.all_completed) == ("SPEDITO", 100, True)
    note = P.completion_notifications(frame).collect()
    assert len(note) == 1 and note[0].created_at == at(9)


def test_code_mode_does_not_mark_articles(spark, articles):
    log = [event(2, "LASER", "complete", 5)]
    _, states, _, _, _ = run(spark, articles, log, "code")
    assert [states[i].next_phase for i in (0, 1)] == ["LASER", "LASER"]


def test_partial_completion(spark, articles):
    log = [
        event(1, "PIEGA", "start", 0, operator="anna"),
        event(2, "PIEGA", "start", 1, operator="ugo"),
        event(3, "PIEGA", "complete_partial", 2, [0, 7]),
        event(4, "PIEGA", "complete", 3),
        event(5, "LASER", "complete_partial", 1, [0, 1]),
        event(6, "LASER", "complete_partial", 4, []),
        event(7, "VERNICE", "complete", 4),
        event(8, "LASER", "complete", 9, order=99),
    ]
    steps, states, rejects, _, _ = run(spark, articles, log)
    # Only one article needs bending, so its mark ends the phase.
    assert steps["PIEGA"].ended_at == at(2) and steps["PIEGA"].operator == "anna"
    assert steps["LASER"].ended_at == at(1) and steps["SALDATURA"].state == "pending"
    assert states[0].completed_phases == ["LASER", "PIEGA"]
    assert rejects == {
        (2, None): "already_started",
        (3, 7): "index_out_of_range",
        (4, None): "already_completed",
        (6, None): "no_articles",
        (7, None): "unknown_step",
        (8, None): "unknown_step",
    }
    steps, _, rejects, _, _ = run(spark, articles, log, "code")
    # All articles must be marked here, so the whole completion ends it later.
    assert steps["PIEGA"].ended_at == at(3)
    assert (4, None) not in rejects


def test_fold_ignores_order_and_repeats(spark, articles):
    log = [
        event(i, p, a, i, [i % 3] if a == "complete_partial" else None, f"op{i}")
        for i, (p, a) in enumerate(
            [(p, a) for p in ("LASER", "PIEGA", "SALDATURA")
             for a in ("start", "complete_partial", "complete", "start")]
        )
    ]
    plain = run(spark, articles, log)[:2]
    shuffled = log * 2
    random.Random(3).shuffle(shuffled)
    assert run(spark, articles, shuffled)[:2] == plain


def test_notes(spark, articles):
    log = [
        event(1, "LASER", "complete_partial", 1, [0], note="a"),
        event(2, "LASER", "complete", 2, note="b"),
        event(3, "LASER", "complete", 3, note="late"),
        event(4, "PIEGA", "complete_partial", 1, [0], note="c"),
        event(5, "PIEGA", "complete", 2, note="late"),
    ]
    df = spark.createDataFrame(log, EVENT)
    steps, _, _ = P.fold_phase_events(df, articles)
    notes = {r.phase: r.note for r in steps.where("note IS NOT NULL").collect()}
    assert notes == {"LASER": "b", "PIEGA": "c"}
    for seed in range(3):  # the register merges from shuffled and repeated events
        random.Random(seed).shuffle(log)
        again = P.fold_phase_events(spark.createDataFrame(log + log[:2], EVENT), articles)[0]
        assert {r.phase: r.note for r in again.where("note IS NOT NULL").collect()} == notes


def test_notes_from_split_batches(spark, articles, tmp_path):
    """Folded rows of batches, in any split, give the notes of the whole log."""
    from orderflow.streaming.fold import current_steps, fold_batch, read_fold

    rng = random.Random(11)
    log = [
        event(i, rng.choice(["LASER", "PIEGA", "SALDATURA"]), rng.choice(["start", "complete_partial", "complete"]),
              rng.randrange(40), [rng.randrange(3)], note=rng.choice([None, "x", "y", f"n{i}"]))
        for i in range(60)
    ]
    want = sorted(map(str, P.fold_phase_events(spark.createDataFrame(log, EVENT), articles)[0].collect()))
    rng.shuffle(log)
    for b in range(4):
        fold_batch(spark.createDataFrame(log[b * 15 : (b + 1) * 15], EVENT)).write.parquet(f"{tmp_path}/batch={b}")
    got = current_steps(read_fold(spark, str(tmp_path)), articles)
    assert sorted(map(str, got.collect())) == want


def test_null_phases(spark):
    """A null entry is no phase and no article."""
    rows = [(1, 0, "A", 1.0, ["LASER", None]), (1, 1, "B", 1.0, [None, "PIEGA", "LASER"]), (1, 2, "C", 1.0, None), (2, 0, "D", 1.0, [None])]
    got = {(r.order_id, r.phase): (r.n_articles, r.n_required, r.seq) for r in P.seed_steps(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert got == {(1, "LASER"): (3, 2, 0), (1, "PIEGA"): (3, 1, 0)}


def test_completed_phases_in_step_order(spark):
    rows = [(1, 0, "A", 1.0, ["SALDATURA", "PULIZIA", "LASER"]), (1, 1, "B", 1.0, ["SALDATURA", "LASER"])]
    articles = spark.createDataFrame(rows, ARTICLE)
    log = [event(1, "LASER", "complete", 1), event(2, "PULIZIA", "complete_partial", 2, [0, 1]), event(3, "SALDATURA", "complete", 3)]
    for mode in P.MODES:
        _, states, _, _, _ = run(spark, articles, log, mode)
        whole = ["SALDATURA", "PULIZIA", "LASER"] if mode == "contract" else ["PULIZIA"]
        assert states[0].completed_phases == whole
        # B does not need PULIZIA but was marked for it.
        assert states[1].completed_phases == (["SALDATURA", "LASER", "PULIZIA"] if mode == "contract" else ["PULIZIA"])


def test_badges_and_remaining(spark, articles):
    log = [event(1, "LASER", "complete_partial", 1, [0])]
    df = spark.createDataFrame(log, EVENT)
    steps, done, _ = P.fold_phase_events(df, articles)
    states = Q.article_states(articles, done, steps)
    badges = {(r.idx, r.phase): r.badge for r in Q.phase_badges(states).collect()}
    assert badges == {
        (0, "LASER"): "completed", (0, "PIEGA"): "next", (0, "SALDATURA"): "pending",
        (1, "LASER"): "next", (1, "SALDATURA"): "pending",
    }
    left = Q.remaining_articles(articles, done, "LASER").collect()
    assert [r.idx for r in left] == [1]


def test_mode_is_checked(spark, articles):
    with pytest.raises(ValueError):
        P.fold_steps(articles, articles, articles, mode="other")


def test_order_requests(spark):
    raw = spark.createDataFrame(
        [
            ('{"order_id":"a","cliente":"X","data_consegna":"2026-03-01T00:00:00",'
             '"articles":[{"name":"S","code":"c","qty":2,"required_phases":["LASER"]},'
             '{"name":"T","qty":"3.5","required_phases":"LASER  PIEGA"},{"code":"z"}],'
             '"required_phases":[]}',),
            ('{"order_id":"b","cliente":"Y","note":"n","required_phases":["PIEGA"],"preventivo_minuti":9}',),
        ],
        "json string",
    )
    orders = {r.order_id: r for r in O.orders_from_json(raw).collect()}
    a, b = orders["a"], orders["b"]
    assert a.due == dt.datetime(2026, 3, 1)
    assert a.required_phases == ["LASER", "PIEGA", "SALDATURA"] and a.total_quantity == 5.5
    assert [x.required_phases for x in a.articles] == [["LASER"], ["LASER", "PIEGA"], []]
    assert (a.articles[2].name, a.articles[1].code, a.estimate_minutes, a.note) == ("N/A", "", 0, "")
    assert (b.articles, b.required_phases, b.estimate_minutes, b.note) == ([], ["PIEGA"], 9, "n")
    rows = O.explode_articles(O.orders_from_json(raw)).orderBy("idx").collect()
    assert [(r.order_id, r.idx) for r in rows] == [("a", 0), ("a", 1), ("a", 2)]
    seeded = P.seed_order_steps(O.orders_from_json(raw)).collect()
    assert len(seeded) == 4
    assert O.orders_to_json(O.orders_from_json(raw)).count() == 2


def test_form_articles(spark):
    df = spark.createDataFrame(
        [([("A", "", "5"), ("", "x", "5"), ("B", "y", "0"), ("C", "z", "3.9")],)],
        "a array<struct<name:string,code:string,qty:string>>",
    )
    none = F.array().cast("array<string>")
    got = df.select(O.valid_form_articles(F.col("a"), none).alias("v")).first().v
    assert [(x.name, x.code, x.qty) for x in got] == [("A", "N/A", 5.0), ("C", "z", 3.0)]
    assert got[0].required_phases == ["LASER", "PIEGA", "SALDATURA"]


def test_first_steps(spark):
    df = spark.createDataFrame(
        [(2, 1, "LASER"), (1, 1, "LASER"), (3, 1, "PIEGA")], "step_id int, order_id int, phase string"
    )
    assert sorted(r.step_id for r in O.first_steps(df).collect()) == [1, 3]


def test_long_orders_are_whole(spark):
    df = spark.range(1500).selectExpr("1L AS order_id", "id AS idx", "concat('c', id) AS code")
    row = O.nested_articles(df, ["code"]).collect()
    assert len(row) == 1 and [a.idx for a in row[0].articles] == list(range(1500))


def test_nested_articles_are_paged(spark):
    rows = [(1, i, f"c{i}", 1.0, ["LASER"]) for i in range(25)]
    df = spark.createDataFrame(rows, ARTICLE)
    pages = O.nested_articles(df, ["code"], page_size=10).orderBy("page").collect()
    assert [len(p.articles) for p in pages] == [10, 10, 5]
    assert [a.code for p in pages for a in p.articles] == [f"c{i}" for i in range(25)]
