"""Queries of these operators that have SQL, against it."""

import compare
import pytest

from orderflow.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert compare.difference(queries.QUERIES[name](spark, FOLDER), compare.connect(FOLDER), queries.SQL[name]) == ""
