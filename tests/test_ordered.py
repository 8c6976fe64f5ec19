"""Places and rank metrics in ranges against brute force: skewed scores, ties of half a group, null groups and keys."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import metrics, ordered, resample

GROUPS = ("a", "b", None)


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(5)
    data = []
    for line in range(3000):
        u = r.random()
        p = 0.25 if u < 0.5 else 1 - 10 ** -(9 * u) if u < 0.9 else None if u > 0.995 else round(u, 3)
        data.append((r.choice(GROUPS), line % 700, line, int(r.random() < (0.6 if (p or 0) > 0.5 else 0.4)), p))
    return data, spark.createDataFrame(data, "view string, line int, view_pos int, label int, probability double").repartition(5).cache()


def low(p):
    return -1.0 if p is None else p


def by_group(df, name):
    return {r["view"]: r[name] for r in df.collect()}


def test_auc(scored):
    data, df = scored
    got = by_group(metrics.roc_auc(df, ["view"]), "auc")
    for g in GROUPS:
        pos, neg = ([low(p) for v, _, _, l, p in data if v == g and l == k] for k in (1, 0))
        want = sum((x > y) + (x == y) / 2 for x in pos for y in neg) / len(pos) / len(neg)
        assert got[g] == pytest.approx(want)


def test_average_precision(scored):
    data, df = scored
    got = by_group(metrics.average_precision(df, ["view"], ["line", "view_pos"]), "average_precision")
    for g in GROUPS:
        hits = total = 0
        for k, row in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-low(x[4]), x[1], x[2])), 1):
            hits += row[3]
            total += row[3] * hits / k
        assert got[g] == pytest.approx(total / hits)


def test_optimal_threshold(scored):
    data, df = scored
    rows = df.where("probability is not null")
    got = {r["view"]: (r["threshold"], r["balanced"]) for r in metrics.optimal_threshold(rows, ["view"], "probability").collect()}
    for g in GROUPS:
        of = [(p, l) for v, _, _, l, p in data if v == g and p is not None]
        P = sum(l for _, l in of)
        N = len(of) - P
        goal = lambda t: sum(l for p, l in of if p >= t) * N + sum(1 - l for p, l in of if p < t) * P
        t = min({p for p, _ in of}, key=lambda t: (-goal(t), abs(t), t))
        assert got[g] == (t, pytest.approx(goal(t) / (2 * P * N)))


@pytest.mark.parametrize("by", [["view"], []])
def test_places(spark, by):
    r = random.Random(7)
    keys = [f"img/é_{r.choice('01')}{r.randrange(10**k):0{k}d}" for k in (1, 4, 12) for _ in range(150)] + ["", "img", "zz" * 50]
    data = [(r.choice(GROUPS), k) for k in sorted(set(keys))] + [("a", None)]
    df = spark.createDataFrame(data, "view string, key string").repartition(3)
    got = {(x["view"], x["key"]): (x["place"], x["n"]) for x in ordered.places(df, by, "key", "place", "n").collect()}
    for g in GROUPS if by else [0]:
        of = sorted((x for x in data if not by or x[0] == g), key=lambda x: (x[1] or "").encode() if x[1] is not None else b"")
        of.sort(key=lambda x: x[1] is not None)
        assert [got[x] for x in of] == [(i, len(of)) for i in range(len(of))]


def test_empty(spark):
    df = spark.createDataFrame([], "view string, key string, label int, probability double, line int")
    assert not ordered.places(df, ["view"], "key", "i").collect() and not ordered.places(df, [], "key", "i").collect()
    assert not metrics.average_precision(df, ["view"], ["line"]).collect()


def test_numbers_are_places_too(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 2).withColumn("key", -F.col("id"))
    got = resample.numbered(df, ["g"], "key").collect()
    assert all(x["i"] == (498 + x["g"] - x["id"]) // 2 and x["n"] == 250 for x in got)
