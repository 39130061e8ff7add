"""Every catalogue query against its SQL on the same tables."""

import sys
from pathlib import Path

import compare
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_point  # noqa: E402
from orderflow.plans import catalog, order_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = entry_point.oracle_sql()
QUERIES = {k: q for k, q in entry_point.queries().items() if k in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and [r.due for r in rows] == sorted(r.due for r in rows)


@pytest.mark.parametrize("query, sink, tables", [("orders_appended", "write_orders_batch", 1), ("batch_report", "write_report", 2)])
def test_repeated_writes_compute_once(spark, monkeypatch, query, sink, tables):
    """What is written several times is read from a table: no write runs the fold again."""
    plans, write = [], getattr(order_queries, sink)

    def seen(*args, **options):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in args[:tables])
        return write(*args, **options)

    monkeypatch.setattr(order_queries, sink, seen)
    order_queries.QUERIES[query](spark, FOLDER).collect()
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)
