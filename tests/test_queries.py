"""A query of each kind against DuckDB on the smallest tables; the rest are checked at a larger scale by the driver."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corroborate.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "PRJ01 PRJ02 PRJ08 PRJ19 AGG03 AGG07 AGG13 AGG19 AGG33 JON01 JON15 WIN01 WIN03 WIN10 WIN13 STA01 SRT01 SET04 SCA04 SCA06 SPL01 SPL05 SPL09 DIF02 DIF08 DIF11 EVL03 SRC04 SRC07 SRC10 UDF01 STR01 STR05".split()


def _cell(value):
    if isinstance(value, float):
        return f"{value:.6g}" if value else "0"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(_cell(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(registry.oracles()[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(_cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
