"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith(("op", "pipeline"))))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "documents", "conversations", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    assert len(got) == len(rows) and got == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
