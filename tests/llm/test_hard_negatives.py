"""Hard negatives against a brute force in whole numbers of Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievemark.llm.hard_negatives import LONG, mine

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, low=80, high=100, k=5):
    fine = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: max(-LONG, min(LONG, sum(x * y for x, y in zip(a, b))))
    at = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, l, v) in enumerate(fine):
        if i is None or i % 100:
            continue
        scores = [(score(v, w), j, m == l, r) for r, (j, m, w) in enumerate(fine)]
        for p, j, *_ in sorted([s for s in scores if s[2] and s[3] != n], key=at)[:k]:
            hits = sorted([s for s in scores if not s[2] and low * p <= 100 * s[0] <= high * p], key=at)[:k]
            out += [(i, j, r + 1, x, p, y) for r, (y, x, *_) in enumerate(hits)]
    return out


def vectors(rng, n, d=6, spread=0.3, centres=4):
    c = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    return [(i, rng.randrange(3), [x + rng.gauss(0, spread) for x in c[i % centres]]) for i in range(n)]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("row", "id", "cell", "block", "group", "v", "rank")})
    got = [tuple(r) for r in mine(df, F.col("id") % 100 == 0, **kw).collect()]
    key = lambda x: tuple(math.inf if y is None else y for y in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_blocks_and_clusters(spark):
    rows = vectors(random.Random(1), 1500)
    assert len(check(spark, rows, block=200, anchor_block=4, clusters=3)) > 100


def test_ties_and_repeats(spark):
    rng = random.Random(2)
    one = [0.5, -0.25, 1.0]
    rows = [(i, i % 2, one) for i in range(250)]  # all scores equal
    rows += [(300 + i, rng.randrange(3), [rng.choice((0.0, 0.25, 0.5)) for _ in range(3)]) for i in range(250)]
    rows += [(None, 0, one), (None, 1, one)]
    check(spark, rows, block=64)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(100 * i, i % 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(6)] + [(i, rng.randrange(2), [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 60)]
    rows += [(61, None, [1.0] * 4), (62, 1, None), (63, 1, [1.0, None, 1.0, 1.0]), (64, 0, [math.nan] * 4), (65, 0, [math.inf, 1.0, 1.0, 1.0]), (66, 1, [-math.inf] * 4), (67, 1, []), (68, 0, [0.0] * 4), (69, 0, [1.0]), (600, 1, []), (700, 0, [0.0] * 4), (800, 7, [1.0] * 4)]
    check(spark, rows)
    assert mine(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0
    assert mine(spark.createDataFrame([(1, 1, [1.0])], SCHEMA), F.col("id") % 100 == 0).count() == 0


def test_scores_past_doubles_and_longs(spark):
    rng = random.Random(4)
    rows = [(i * 10, i % 2, [rng.uniform(-1, 1) * 10.0**e for _ in range(3)]) for i, e in enumerate([5, 5, 6, 6, 7, 7, 8, 8, 30, 30, 30, 30] * 3)]
    check(spark, rows)


def test_walks_end_early():
    """Near clusters are certified without walking all rows."""
    import numpy as np
    import pyarrow as pa

    from sievemark.llm import hard_negatives as H

    rng = np.random.default_rng(5)
    centre = np.eye(8)[:4] * 3
    v = np.repeat(centre, 2000, axis=0) + rng.normal(0, 0.02, (8000, 8))
    seen = []
    plain = H._scores
    H._scores = lambda r, m, most: (seen.append(len(r)), plain(r, m, most))[1]
    try:
        table = lambda x, first: pa.table({"id": np.arange(first, first + len(x)), "row": np.arange(first, first + len(x)), "label": np.zeros(len(x), np.int64), "v": pa.array(x.tolist(), pa.list_(pa.float64())), "cell": np.zeros(len(x), np.int32)})
        H._positives(256.0, 5)(table(v, 0), table(v[:10], 100_000))
    finally:
        H._scores = plain
    assert sum(seen) < 4000
