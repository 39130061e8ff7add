"""Substring and prefix joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import matching as M
from orderflow.operators import orders as O


def test_containing(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 30)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab")]
    keys = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 2, 2, 3, 3, 3, 4, 5, 6, 7, 8)] + ["abc", "a", None, "", "zzz", "zzzz", "a"]
    found = M.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    want = {(i, k) for i, t in texts for k in keys if t and k and k in t}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_first_contained(spark):
    texts = spark.createDataFrame([(1, "/a/0173.txt"), (2, "/b/0445-0173.txt"), (3, "none"), (4, None)], "doc_id long, text string")
    entries = [("0445", "B", 2), ("0173", "A", 1), ("0173", "C", 3), ("none", "", 0), ("one", None, 0), (None, "D", 0)]
    found = M.first_contained(texts, spark.createDataFrame(entries, "key string, value string, rank int"))
    assert {r.doc_id: r.value for r in found.collect()} == {1: "A", 2: "A", 3: None, 4: None}
    empty = M.first_contained(texts, spark.createDataFrame([], "key string, value string, rank int"))
    assert {r.value for r in empty.collect()} == {None}


def joined_rows(df):
    """Rows that the joins of a query that has run put out, the largest number of one join."""
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif name.endswith("JoinExec"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_keys_that_share_grams_do_not_multiply(spark):
    """Four times as many texts and keys make four times as many rows in a join, not sixteen."""
    for n in (500, 2000):
        texts = [(i, f"http://a.b/{i:012b}/x") for i in range(n)]
        keys = spark.createDataFrame([(f"/{i:012b}",) for i in range(n)], "key string")
        found = M.containing(spark.createDataFrame(texts, "doc_id long, text string"), keys)
        assert {tuple(r) for r in found.collect()} == {(i, f"/{i:012b}") for i in range(n)}
        assert n <= joined_rows(found) <= 4 * n


@pytest.mark.parametrize("firsts", [M.FIRSTS, 2])
def test_long_and_repeated_keys(spark, monkeypatch, firsts):
    """Keys above the length that is compared as it is, of equal beginnings; keys that a text holds more than once."""
    monkeypatch.setattr(M, "FIRSTS", firsts)
    keys = ["ab" * 40 + str(i) for i in range(20)] + ["ab" * 32, "é" * 70, "ab", "b", "zz" * 50]
    texts = [(i, "x" * i + "ab" * 50 + str(i)) for i in range(20)] + [(50, "é" * 71), (51, "aé" * 3), (52, "abab"), (53, "b"), (54, "")]
    found = M.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == {(i, k) for i, t in texts for k in keys if k in t} and len(set(got)) == len(got)
    assert ("strategy=broadcast" in found._jdf.queryExecution().toString()) == (firsts > 2)


def test_longest_prefix(spark):
    rows = spark.createDataFrame([(1, "13R025108"), (2, "13R1"), (3, "9"), (4, None), (5, ""), (6, "13R025108")], "i long, code string")
    mapping = spark.createDataFrame([("13R", 1.0), ("13R025", 2.5), ("13R025", 3.0), ("13R0251089", 9.0), ("", 7.0), (None, 8.0)], "prefix string, value double")
    found = {r.i: r.value for r in M.longest_prefix(rows, mapping).collect()}
    assert found == {1: 2.5, 2: 1.0, 3: None, 4: None, 5: None, 6: 2.5}


def test_rules(spark):
    rules = [("s", "BOTH", 1, "all", "AA"), ("s", "BOTH", 1, "all", "BB"), ("s", "ONE", 2, "any", "CC"), ("s", "ONE", 2, "any", "DD"), ("s", "MIX", 3, "all", "EE"), ("s", "MIX", 3, "any", "FF"), ("s", "REST", 9, "any", None), ("t", "T", 1, "all", "AA")]
    docs = [(1, "aa bb cc"), (2, "xccx"), (3, "ee"), (4, "ee ff"), (5, None), (6, "aa")]
    found = M.first_by_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rules, "rule_set string, layout string, priority int, kind string, word string"))
    got = {(r.doc_id, r.rule_set): r.layout for r in found.collect()}
    assert got == {(1, "s"): "BOTH", (2, "s"): "ONE", (3, "s"): "REST", (4, "s"): "MIX", (5, "s"): "REST", (6, "s"): "REST", (1, "t"): "T", (6, "t"): "T"}


def test_malformed_json(spark):
    good = '{"order_id": "1", "cliente": "A", "articles": [{"name": "n", "qty": "2"}]}'
    raw = [(1, good), (2, good[:-3]), (3, "[]x"), (4, ""), (5, None), (6, "  "), (7, '{"order_id": "7"}'), (8, '{"preventivo_minuti": "abc"}')]
    orders, rejects = O.split_orders_json(spark.createDataFrame(raw, "line long, json string"))
    assert sorted(r.order_id for r in orders.collect()) == ["1", "7"]
    assert {r.line: (r.reason, r.json) for r in rejects.collect()} == {
        2: ("malformed JSON", good[:-3]), 3: ("malformed JSON", "[]x"), 4: ("empty request", ""), 5: ("empty request", None), 6: ("empty request", "  "),
        8: ("malformed JSON", '{"preventivo_minuti": "abc"}'),
    }


def test_first_rows_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    found = O.first_rows(rows, ["k"], [F.desc("id")], 2)
    assert {tuple(r) for r in found.collect()} == {(999 % 3, 999), (998 % 3, 998), (997 % 3, 997), (996 % 3, 996), (995 % 3, 995), (994 % 3, 994)}
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
