"""Every registered query of the engine equals its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidebook.plans.catalogue import QUERIES
from tidebook.plans.oracles import ORACLES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    expected = sql.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    order = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in expected.fetchall()), key=repr)


def test_flagship_plan_has_map_side_combine_and_two_exchanges(spark, sf_dir):
    plan = QUERIES["book_top"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


@pytest.mark.parametrize("name", ["check_verdict", "replay_dump", "compare_full", "book_after_snapshot", "hist_quantile_ns"])
def test_anchored_queries_scan_few_tables(spark, sf_dir, name):
    """What a query derives from the feed is written once and then read a few times."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4 - (name in ("check_verdict", "replay_dump"))
