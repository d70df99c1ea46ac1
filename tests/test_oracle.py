"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from graphvec import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(names)
    return sorted((tuple(plain(dict(zip(names, r))[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sql, name):
    df = core.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in core.oracle_sql():
        assert got
        return
    wanted = sql.execute(core.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, wanted.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["id", "score", "neighbour", "weight"]
    assert set(core.queries()) <= set(__spark_entry__.queries())
