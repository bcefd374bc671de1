"""Every registered query of the core runs on the smallest tables, and agrees with its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"lowest_similarity", "changed_regions", "fold_tokens"}  # matching blocks and NFKC; tests/test_operators.py and test_bundles_ledgers.py hold them against Python
NAMES = [k for k, f in entry.queries().items() if ".llm" not in f.__module__]


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 5) if hasattr(v, "__float__") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(FOLDER):
        c.execute(f"create view {n.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{n}')")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    assert len(df.columns) == len(set(df.columns)) and (sql or name in WITHOUT_SQL)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert got == sorted((tuple(value(r[i]) for i in order) for r in cur.fetchall()), key=repr)
