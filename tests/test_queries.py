"""Every registered query of the library against its DuckDB twin on the small tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from siftlake.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(found, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows((r.asDict() for r in df.collect()), columns)
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    assert got == rows((dict(zip(found.columns, r, strict=True)) for r in found.fetchall()), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scorecard_joins_on_hashes(spark):
    plan = QUERIES["recall_scorecard"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_needed_columns_only(spark):
    plan = QUERIES["in_scope_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "p_retailprice" not in plan
