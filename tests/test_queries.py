"""Every registered query beside its SQL on the smallest tables, and what no plan may hold."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted((tuple(str(r[i]) for i in at) for r in rows))


BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin"]
PYTHON = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    """Its rows are those of its SQL; its plan holds no nested loop and, outside the `llm` subpackage, no Python."""
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    llm = name == "pipeline" or re.match(r"op\d+_", name)
    assert not [b for b in BANNED + ([] if llm else PYTHON) if b in plan]
    if name not in entry.oracle_sql():
        assert df.count() > 0
        return
    columns = sorted(df.columns)
    cur = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert rows_of(columns, df.columns, df.collect()) == rows_of(columns, names, cur.fetchall())


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
