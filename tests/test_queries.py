"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from sievemark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "as_tuple"):
        v = float(v)
    return f"{v:.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].asDict())


def test_curve_means_on_a_bound(spark, tmp_path):
    """Means that are 50.005, the bound, whatever order their values are added in."""
    from datetime import datetime
    from itertools import permutations

    cents = [(5000, 5001, 5000, 5001), (1234, 8767, 3, 9998), (10, 20, 30, 19942), (7, 4093, 6001, 9901)]
    orders = [[c / 100 for c in p] for row in cents for p in sorted(set(permutations(row)))]
    assert len({sum(o) / 4 >= 50.005 for o in orders}) == 2 and all(sum(row) == 20002 for row in cents)
    data = [(u * 4 + i, datetime(2024, 1, 1, i), u, "view", v) for u, o in enumerate(orders) for i, v in enumerate(o)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert registry.QUERIES["g26_stable_count"](spark, str(tmp_path)).first().stable == len(orders)
    assert c.sql(registry.ORACLE_SQL["g26_stable_count"]).fetchall() == [(len(orders),)]


def test_fingerprint_deals_rows_evenly(spark):
    """Not by language: there are four, and a task would get all texts of one."""
    plan = registry.QUERIES["s18_fingerprint"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(lang" not in plan
