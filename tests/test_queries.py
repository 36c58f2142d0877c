"""Registered queries give the rows of their SQL on the smallest tables."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows):
    one = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([one(v) for v in r]) for r in rows)


def test_queries_equal_sql(spark, duck):
    from agentlake.plans import index_queries, more_queries  # noqa: F401 - add their own
    from agentlake.plans.queries import ORACLE_SQL, QUERIES

    wrong = []
    for name, run in QUERIES.items():
        df = run(spark, DATA)
        columns = sorted(df.columns)
        got = df.select(*columns).collect()
        if name in ORACLE_SQL:
            listed = ", ".join(f'"{c}"' for c in columns)
            want = duck.sql(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall()
            if plain(tuple(r) for r in got) != plain(want):
                wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
