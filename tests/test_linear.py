"""Probes and the comparison against plain numpy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import gates, linear, replicates
from sievemark.operators.sampling import group_folds


def weights(y):
    return np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))


def logistic(x, y, ridge):
    """Least of sum of weighted losses plus ridge / 2 for each squared coefficient but the last, the intercept."""
    m, w, r = np.column_stack([x, np.ones(len(x))]), weights(y), np.diag([ridge] * x.shape[1] + [0.0])
    beta = np.zeros(m.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(m @ beta)))
        beta -= np.linalg.solve((m.T * (w * p * (1 - p))) @ m + r, m.T @ (w * (p - y)) + r @ beta)
    return beta


def auc(x, y):
    return np.mean([(u > x[y == 0]).mean() + (u == x[y == 0]).mean() / 2 for u in x[y == 1]])


def test_leakage_probe(spark):
    rng = np.random.default_rng(3)
    n = 240
    y, g = rng.integers(0, 2, n), rng.integers(0, 5, n)
    a, b = rng.normal(size=n) + 0.6 * y, rng.normal(size=n) * 3 + 1
    rows = [(f"s{i}", int(y[i]), f"g{y[i]}{g[i]}", f"{i:064x}", float(a[i]), float(b[i]), 2.0) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, label int, group_id string, content_sha256 string, a double, b double, same double")
    fold = {r.sample_id: r.fold for r in group_folds(df, 3, 5).collect()}
    k = np.array([fold[r[0]] for r in rows])
    x = np.column_stack([a, b, np.full(n, 2.0)])
    p = np.empty(n)
    for f in set(k):
        t = k != f
        s = np.where(x[t].std(axis=0) < 1e-8, 1, x[t].std(axis=0))
        z = (x - x[t].mean(axis=0)) / s
        beta = logistic(z[t], y[t], 1e-3)
        p[~t] = (np.column_stack([z, np.ones(n)]) @ beta)[~t]
    got = linear.leakage_probe(df, ["a", "b", "same"], 3, 5).first()
    assert got.auc == pytest.approx(auc(p, y), abs=2e-3) and got.grouped and got.n == n
    assert got.balanced_accuracy == pytest.approx(((p >= 0)[y == 1].mean() + (p < 0)[y == 0].mean()) / 2, abs=0.02)
    assert got.passed == (got.auc <= 0.6)


def test_linear_probe(spark):
    rng = np.random.default_rng(4)
    n, d = 200, 4
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) + y[:, None] * 0.8
    role = ["calibration" if i % 3 else "test" for i in range(n)]
    group = [f"f{rng.integers(0, 4)}" if v else "real" for v in y]
    df = spark.createDataFrame([(f"s{i}", "clean", int(y[i]), group[i], role[i], x[i].tolist()) for i in range(n)], "sample_id string, view string, label int, group_id string, role string, features array<double>")
    names = sorted({g for g, r, v in zip(group, role, y) if v and r == "calibration"})
    real = lambda i: int.from_bytes(hashlib.sha256(f"s{i}".encode()).digest()[:8], "big") % len(names)
    cal, u = np.array([r == "calibration" for r in role]), x / np.linalg.norm(x, axis=1, keepdims=True)
    k = np.array([(names.index(group[i]) if y[i] else real(i)) if cal[i] else -1 for i in range(n)])
    want = {}
    for f in range(len(names)):
        t = cal & (k != f)
        beta = logistic(u[t], y[t], 1e-3 * t.sum())
        want |= {f"s{i}": ("out_of_fold", float(np.append(u[i], 1) @ beta)) for i in np.flatnonzero(cal & (k == f))}
    beta = logistic(u[cal], y[cal], 1e-3 * cal.sum())
    want |= {f"s{i}": ("all_calibration", float(np.append(u[i], 1) @ beta)) for i in np.flatnonzero(~cal)}
    got = {r.sample_id: (r.probe_fit, r.raw_logit) for r in linear.linear_probe(df, "features").collect()}
    assert got.keys() == want.keys() and all(got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1], abs=2e-3) for s in want)
    with pytest.raises(ValueError, match="three positive groups"):
        linear.linear_probe(df.where("group_id in ('f0', 'f1', 'real')"), "features")


def test_compare(spark):
    r = random.Random(6)
    rows = [(f"s{i}", v, i % 2, f"g{i % 6}", i, min(1.0, max(0.0, r.gauss(0.35 + 0.3 * (i % 2), 0.2)))) for i in range(120) for v in ("clean", "web")]
    a = spark.createDataFrame(rows, "sample_id string, view string, label int, group_id string, line int, probability double")
    b = a.withColumn("probability", F.when(F.col("label") == 1, F.least(F.lit(1.0), F.col("probability") + 0.3)).otherwise(F.col("probability") * 0.7))
    t, R = 0.5, 40
    found = gates.compare(a, b, t, R, 3)
    y, p = np.array([x[2] for x in rows]), np.array([x[5] for x in rows])
    q = np.where(y == 1, np.minimum(1, p + 0.3), p * 0.7)
    ok = lambda x: np.where(y == 1, x >= t, x < t).astype(int)
    c = {(r.label, r.sample_id): np.frombuffer(r.counts, "<u4") for r in replicates.replicate_counts(a.select("label", "sample_id").distinct(), ["label"], "sample_id", R, 3).collect()}
    w = np.array([c[x[2], x[0]] for x in rows])
    rate = lambda d, l, k: (d * w[:, k])[y == l].sum() / w[y == l, k].sum()
    deltas = [(rate(ok(q) - ok(p), 1, k) + rate(ok(q) - ok(p), 0, k)) / 2 for k in range(R)]
    got = found["intervals"].where("metric = 'delta_balanced_accuracy'").first()
    assert (got.low, got.high, got.mean) == pytest.approx((*np.quantile(deltas, [0.025, 0.975]), np.mean(deltas))) and got.promote == (got.low > 0)
    groups = {r.group_id: r for r in found["groups"].collect()}
    assert len(groups) == 6


def test_leakage_probe_reads_its_input_once(spark):
    """Rows whose features cost much are made once, however many folds and steps there are (the folds' groups are found before, from their own columns)."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        made.add(1)
        return x * 2

    rng = np.random.default_rng(7)
    rows = [(f"s{i}", i % 2, f"g{i % 2}{i % 12 // 2}", f"{i:064x}", float(rng.normal() + i % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "sample_id string, label int, group_id string, content_sha256 string, x double").withColumn("a", costly("x"))
    assert linear.leakage_probe(df, ["a"], 3, 5).first().n == 240
    assert made.value == 240
