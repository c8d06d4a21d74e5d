"""Registered queries against their DuckDB twins on tables with keys as large as those of large copies."""

import duckdb
import pytest

import __spark_entry__
from tests.test_queries import SF, TABLES, pytestmark, rows  # noqa: F401


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """A folder of the tables in which every hundredth order stands with keys of the fiftieth copy of a larger table."""
    folder, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    chosen = {
        "lineitem": "* REPLACE (l_orderkey + 7500000 AS l_orderkey, l_partkey + 1000000 AS l_partkey, l_suppkey + 50000 AS l_suppkey)",
        "orders": "* REPLACE (o_orderkey + 7500000 AS o_orderkey)",
    }
    for name in TABLES:
        where = {"lineitem": "WHERE l_orderkey // 2 % 100 < 3", "orders": "WHERE o_orderkey // 2 % 100 < 3"}.get(name, "")
        con.execute(f"COPY (SELECT {chosen.get(name, '*')} FROM '{SF}/{name}.parquet' {where}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = con.sql(__spark_entry__.oracle_sql()[name])
    got = rows((r.asDict() for r in df.collect()), columns)
    assert got and got == rows((dict(zip(found.columns, r, strict=True)) for r in found.fetchall()), columns)
    return got, columns


def test_resume_stream_rounds_as_sql(spark, shifted):
    got, columns = against_sql(spark, "resume_stream", shifted)
    assert any(r[columns.index("ord")] > 2**53 for r in got)
