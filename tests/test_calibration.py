"""Fits of all folds at once against plain numpy, fold by fold."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import calibration as C
from sievemark.operators import gates as Q
from sievemark.plans import registry

DATA = "/root/testdata/sf0.001"
TARGET = 0.65
LOGIT = np.log(TARGET / (1 - TARGET))


def sigmoid(z):
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def threshold(x, y):
    s = np.unique(x)
    P, N = int((y == 1).sum()), int((y == 0).sum())
    goal = lambda t: int((y[x >= t] == 1).sum()) * N + int((y[x < t] == 0).sum()) * P
    return min((-goal(t), abs(t), t) for t in [np.nextafter(s[0], -np.inf), *s, np.nextafter(s[-1], np.inf)])[2]


def slope(x, y):
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    m, beta, ridge = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0]), np.diag(C.RIDGE)
    for _ in range(C.STEPS):
        p = sigmoid(m @ beta)
        step = np.linalg.solve((m.T * (w * p * (1 - p))) @ m + ridge, m.T @ (w * (p - y)) + ridge @ beta)
        beta = beta - step
        if np.linalg.norm(step) < C.CLOSE:
            break
    return float(np.clip(beta[0], 1e-3, 100))


def fit(method, x, y):
    if method == "identity":
        return 1.0, 0.0, LOGIT
    t, k = threshold(x, y), 1.0 if method == "bias" else slope(x, y)
    return k, LOGIT - k * t, t


def auc(x, y):
    a, b = x[y == 1], x[y == 0]
    return np.mean([(u > b).mean() + (u == b).mean() / 2 for u in a])


def selected(rows):
    """rows: (sample, group, label, logit)."""
    groups = sorted({g for _, g, l, _ in rows if l == 1})
    of = lambda s, g, l: groups.index(g) if l == 1 else int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") % len(groups)
    fold = np.array([of(*r[:3]) for r in rows])
    x, y, g = (np.array([r[k] for r in rows]) for k in (3, 2, 1))
    scores = {}
    for method in C.METHODS:
        p = np.empty(len(x))
        for k in range(len(groups)):
            a, b, _ = fit(method, x[fold != k], y[fold != k])
            p[fold == k] = sigmoid(a * x[fold == k] + b)
        ok = np.where(y == 1, p >= TARGET, p < TARGET)
        rate = lambda l: np.mean([ok[(y == l) & (g == name)].mean() for name in set(g[y == l])])
        q = np.clip(p, 1e-12, 1 - 1e-12)
        scores[method] = (np.mean([rate(0), rate(1)]), (ok[y == 1].mean() + ok[y == 0].mean()) / 2, ((p - y) ** 2).mean(), -np.where(y == 1, np.log(q), np.log(1 - q)).mean())
    best = min(C.METHODS, key=lambda m: (-scores[m][0], scores[m][3], C.METHODS.index(m)))
    return scores, best, fit(best, x, y), auc(x, y)


def data(seed, n=400, groups=5, grain=None, flip=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        label = r.randrange(2)
        x = flip * (2 * label - 1) * r.choice((0.2, 1.0, 2.0)) + r.gauss(0, 1.5) - 1
        out.append((f"s{seed}-{i}", f"{'f' if label else 'r'}{min(r.randrange(groups), r.randrange(groups))}", label, round(x / grain) * grain if grain else x))
    return out


SCHEMA = "sample_id string, group_id string, label int, raw_logit double"
CASES = [data(1), data(2, grain=0.5), data(3, n=60, groups=3, grain=1.0), data(5, n=80, grain=3.0, flip=-1)]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_selection_equals_numpy(spark, monkeypatch, k):
    rows = CASES[k]
    scores, best, final, area = selected(rows)
    found = C.select_calibrators(spark.createDataFrame(rows, SCHEMA).withColumn("m", F.lit(k)).repartition(3), "m", TARGET)[k]
    for r in found["scores"]:
        assert (r["macro_score"], r["balanced_accuracy"], r["brier"], r["log_loss"]) == pytest.approx(scores[r["method"]], abs=1e-9)
    f = found["final"]
    assert f["method"] == best and (f["slope"], f["intercept"], f["boundary"]) == pytest.approx(final, abs=1e-7)
    assert found["auc"] == pytest.approx(area)


def test_blocks_of_a_task(monkeypatch):
    """The kernels in blocks of a few rows, and counts past 64 bits in their products, give what whole tables give."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 500
    t = pa.table({"m": ["a"] * n, "raw_logit": np.sort(rng.integers(0, 40, n) / 4.0), "fold": rng.integers(0, 4, n).astype(np.int32), "label": rng.integers(0, 2, n).astype(np.int32), "n": rng.integers(1, 9, n), C.PART: np.zeros(n, np.int32)})
    of = lambda l: np.array([t["n"].to_numpy()[(t["fold"].to_numpy() == k) & (t["label"].to_numpy() == l)].sum() for k in range(4)])
    gangs = {"a": C.Gang.of(of(1), of(0), True)}
    zero = {"a": {0: (np.zeros(5, np.int64), np.zeros(5, np.int64))}}
    at = {"a": rng.normal(size=(5, 2))}
    whole = C._thresholds(gangs, zero, "m")(t).to_pylist(), next(C._sums(gangs, at, "m")[0](iter(t.to_batches())))["s"].to_pylist()
    monkeypatch.setattr(C, "BLOCK", 35)
    again = C._thresholds(gangs, zero, "m")(t).to_pylist(), next(C._sums(gangs, at, "m")[0](iter(t.to_batches())))["s"].to_pylist()
    assert whole[0] == again[0] and np.allclose(whole[1], again[1])
    big = t.set_column(4, "n", pa.array(t["n"].to_numpy() * 10**10))
    gangs = {"a": C.Gang.of(of(1) * 10**10, of(0) * 10**10, True)}
    for a, b in zip(C._thresholds(gangs, zero, "m")(big).to_pylist(), whole[0]):
        assert a["t"] == b["t"] and a["goal"] == b["goal"] * 10**20


def test_groups_of_their_own(spark):
    rows = [(s, g, l, x, m) for m in range(3) for s, g, l, x in CASES[m]]
    df = spark.createDataFrame(rows, SCHEMA + ", m int")
    got = {(r.m, r.method): (r.slope, r.intercept, r.boundary) for r in C.fit_calibrators(df, C.METHODS, TARGET, "m").collect()}
    for m in range(3):
        x, y = (np.array([r[k] for r in CASES[m]]) for k in (3, 2))
        for method in C.METHODS:
            assert got[m, method] == pytest.approx(fit(method, x, y), abs=1e-7)
    assert C.platt_slopes(df, "m") == pytest.approx({m: got[m, "platt"][0] for m in range(3)})


def test_needs(spark):
    few = [r for r in CASES[0] if r[1] in ("f0", "f1") or r[2] == 0]
    with pytest.raises(ValueError, match="three positive groups"):
        C.select_calibrator(spark.createDataFrame(few, SCHEMA), TARGET)
    with pytest.raises(ValueError, match="three positive groups"):
        C.select_calibrator(spark.createDataFrame([], SCHEMA), TARGET)
    with pytest.raises(ValueError, match="one class"):
        C.select_calibrator(spark.createDataFrame([r for r in CASES[0] if r[2] == 1], SCHEMA), TARGET)


def test_tournament_is_one_gang(spark):
    """A bound of jobs, however many folds, models and steps; the ranking that comes back is a local table."""
    manifest = spark.createDataFrame([(s, g, l, "calibration") for s, g, l, _ in CASES[0]], "sample_id string, group_id string, label int, role string")
    ledger = lambda k: spark.createDataFrame([(r[0], "clean", r[3] / (k + 1) + k, None) for r in CASES[0]], "sample_id string, view string, raw_logit double, error string")
    sc = spark.sparkContext
    sc.setJobGroup("tournament", "")
    out = Q.rank_tournament(manifest, {"a": ledger(0), "b": ledger(1)}, TARGET, {"a": True, "b": False})
    jobs = len(sc.statusTracker().getJobIdsForGroup("tournament"))
    sc.setJobGroup("rest", "")
    got = {r.model: r for r in out.collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert jobs <= 60 and "Relation" not in plan.replace("LocalRelation", "")
    scores, best, final, area = selected(CASES[0])
    assert got["a"].rank == 1 and got["a"].calibrator == best and got["a"].slope == pytest.approx(final[0], abs=1e-7) and got["a"].macro_score == pytest.approx(scores[best][0]) and got["a"].auc == pytest.approx(area)


def test_queries_equal_numpy(spark):
    """m2, m3, i9 and w9 on the given tables."""
    from sievemark.plans import views as V

    registry.load()
    rows = V.scored(spark, DATA).select("sample_id", "group_id", "label", "raw_logit", "view").collect()
    scores, best, final, area = selected([tuple(r)[:4] for r in rows])
    m3 = {r.method: r for r in registry.QUERIES["m3_select_calibrator"](spark, DATA).collect()}
    assert all((m3[m].macro_score, m3[m].balanced_accuracy, m3[m].brier, m3[m].log_loss) == pytest.approx(scores[m], abs=2e-5) for m in C.METHODS)
    w9 = registry.QUERIES["w9_pick_calibrator"](spark, DATA).first()
    assert w9.method == best and w9.slope == pytest.approx(final[0], abs=1e-4)
    i9 = {r.model: r for r in registry.QUERIES["i9_rank_tournament"](spark, DATA).collect()}
    assert i9["b"].rank == 1 and i9["a"].calibrator == best and (i9["a"].macro_score, i9["a"].auc) == pytest.approx((scores[best][0], area), abs=1e-4)
    for r in registry.QUERIES["m2_platt"](spark, DATA).collect():
        x, y = (np.array([getattr(q, c) for q in rows if q["view"] == r["view"]]) for c in ("raw_logit", "label"))
        assert (r.slope, r.intercept, r.boundary) == pytest.approx(fit("platt", x, y), abs=1e-4)
