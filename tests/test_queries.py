from __future__ import annotations

import os

import pytest
from compare import connection, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from runloom import queries
from runloom.oracle import ORACLE_SQL
from runloom.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    names, got = rows_of_spark(QUERIES[name](spark, SF))
    expected_names, expected = rows_of_sql(con, ORACLE_SQL[name])
    assert names == expected_names
    assert len(got) == len(expected)
    assert got == expected
    assert got


def test_tasks_grow_with_line_items(spark, monkeypatch):
    """Facts of orders are folded by as many tasks as line items ask for, with the same rows."""
    before = sorted(map(tuple, queries.order_facts(spark, SF).collect()))
    monkeypatch.setattr(queries, "TASK_ROWS", 500, raising=False)
    facts = queries.order_facts(spark, SF)
    each = facts.groupBy(F.input_file_name()).agg(F.sum("events").alias("n")).collect()
    assert max(r["n"] for r in each) < 1_000 < sum(r["n"] for r in each)
    assert sorted(map(tuple, facts.collect())) == before


def test_exports_read_written_runs(spark, monkeypatch):
    """Runs are made once, not by each export and each table of it."""
    read, export = [], queries.sinks.export

    def seen(kind, path, tables, full_paths):
        read.extend(f for t in tables.values() for f in t.inputFiles())
        export(kind, path, tables, full_paths)

    monkeypatch.setattr(queries.sinks, "export", seen)
    assert queries.exports(spark, SF).count() == 6
    assert read
    assert not [f for f in read if "orders.parquet" in f]
