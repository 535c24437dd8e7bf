"""Every query with SQL against DuckDB over the smallest tables, and its independence of partitioning."""

import os

import duckdb
import pytest

from spindrift.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def rows(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]) for d in want.description}
    names = sorted(kinds)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert rows(df, names) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_runs_alike_twice(spark, name):
    df = QUERIES[name](spark, SF)
    first = rows(df, df.columns)
    assert first and first == rows(QUERIES[name](spark, SF), df.columns)


def test_main_channel_weighs_ratio_against_number(spark, duck, tmp_path):
    """A ratio slightly larger on a far later channel doesn't win; a channel without values never does."""
    at = f"{tmp_path}/events.parquet"
    values = """SELECT 7 AS user_id, 'a' AS event_type, 10.0 + i % 2 AS value FROM range(8) t(i) UNION ALL SELECT 90007, 'a', 10.01 + i % 2 FROM range(8) t(i)
        UNION ALL SELECT 3, 'a', NULL FROM range(8) t(i) UNION ALL SELECT 3, 'b', i FROM range(8) t(i) UNION ALL SELECT 5, 'c', NULL FROM range(8) t(i) UNION ALL SELECT 5, 'b', i + 9 FROM range(8) t(i)"""
    duck.execute(f"COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (row_number() OVER ()) AS ts, CAST(user_id AS BIGINT) AS user_id, event_type, CAST(value AS DOUBLE) AS value, '' AS props FROM ({values})) TO '{at}' (FORMAT parquet)")
    want = duck.execute(ORACLE_SQL["g12_snr"].replace("FROM events", f"FROM '{at}'")).fetchall()
    got = rows(QUERIES["g12_snr"](spark, str(tmp_path)), ["kind", "main_channel", "snr"])
    assert got == sorted(want, key=str) and ("a", 7) in {r[:2] for r in got} and ("c", None, None) in got
