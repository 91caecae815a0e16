"""Every query with SQL gives the SQL's rows; every other one runs."""

import pytest

import __spark_entry__ as entry
from oracle import spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(entry.queries()[name](spark, FOLDER)) == sql_rows(SQL[name], FOLDER)


@pytest.mark.parametrize("name", ["search_snippets", "kmeans_assign", "pick_k", "p7_found", "p7_times"])
def test_runs(spark, name):
    got = entry.queries()[name](spark, FOLDER)
    got.selectExpr(*(f"cast(`{c}` as string)" for c in got.columns)).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
