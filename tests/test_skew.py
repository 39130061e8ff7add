"""One order holds a third of all articles and events: results stay the same."""

import shutil

import compare
import pytest
from pyspark.sql import functions as F

from orderflow.operators import positions
from orderflow.plans import catalog

FOLDER = "/root/testdata/sf0.001"
HOT = 42


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    for name in compare.TABLES:
        path = target / f"{name}.parquet"
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "lineitem":
            hot = F.col("l_partkey") % 3 == 0
            df = df.withColumn("l_orderkey", F.when(hot, HOT).otherwise(F.col("l_orderkey")))
        elif name == "events":
            hot = F.col("event_id") % 3 == 0
            df = df.withColumn("user_id", F.when(hot, HOT // 10).otherwise(F.col("user_id")))
        else:
            shutil.copy(f"{FOLDER}/{name}.parquet", path)
            continue
        df.coalesce(1).write.parquet(str(target / name))
        shutil.copy(next((target / name).glob("*.parquet")), path)
    return str(target)


@pytest.mark.parametrize(
    "name",
    [
        "step_fold",
        "phase_rejects",
        "article_next_phase_contract",
        "station_queue_laser",
        "order_documents",
        "cutting_plan",
        "extract_mixed_items",
        "extract_for_ordine_items",
        "stream_step_fold",
    ],
)
def test_query(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(positions, "HOT_ROWS", 300)
    monkeypatch.setattr(positions, "SMALL_INPUT_BYTES", 0)
    con = compare.connect(skewed)
    query, sql = catalog.QUERIES[name], catalog.SQL[name]
    assert compare.difference(query(spark, skewed), con, sql) == ""
