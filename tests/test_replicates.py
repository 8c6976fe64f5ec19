"""Bootstrap draws by the splitting tree: exact sizes, the right distribution, and the statistics of given draws against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import gates, ordered, replicates, resample

SCHEMA = "sample_id string, group_id string, view string, label int, probability double"


def rows_of(seed, n=300, grain=20, groups=7):
    r = random.Random(seed)
    out = []
    for i in range(n):
        label = int(r.random() < 0.4)
        for view in ("clean", "web"):
            p = min(1, max(0, r.gauss(0.4 + 0.25 * label, 0.25)))
            out.append((f"s{i:04d}", f"g{label}{min(r.randrange(groups), r.randrange(groups))}", view, label, round(p * grain) / grain))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = rows_of(1)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_tree():
    n, R = 1000, 4000
    c = replicates.tree_counts(0, n, n, R, 5, "g")
    assert (c.sum(axis=1) == n).all() and (c >= 0).all()
    # Counts of one cluster are Binomial(n, 1/n), and two clusters' counts have covariance -1/n.
    assert abs(c.mean() - 1) < 1e-9 and abs(c[:, ::50].var(axis=0).mean() - (1 - 1 / n)) < 0.03
    assert abs((c == 0).mean() - (1 - 1 / n) ** n) < 0.003 and abs(np.cov(c[:, 3], c[:, 800])[0, 1]) < 0.06
    assert abs(c[:, : n // 2].sum(axis=1).var() - n / 4) < 15
    for a, b in ((0, 1), (63, 65), (130, 700), (999, 1000)):
        assert (replicates.tree_counts(a, b, n, R, 5, "g") == c[:, a:b]).all()
    assert (replicates.tree_counts(0, n, n, 50, 6, "g") != c[:50]).any() and (replicates.tree_counts(0, 1, 1, 3, 5, "g") == 1).all()


def counts_of(df, key, R, seed):
    return {tuple(r)[:2]: np.frombuffer(r.counts, "<u4") for r in replicates.replicate_counts(df.select("label", key).distinct(), ["label"], key, R, seed).collect()}


def test_same_draws_on_any_partitioning(spark, scored):
    _, df = scored
    a, b = counts_of(df, "sample_id", 30, 3), counts_of(df.repartition(2), "sample_id", 30, 3)
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)
    for label in (0, 1):
        own = [v for (l, _), v in a.items() if l == label]
        assert (np.sum(own, axis=0) == len(own)).all()


def limits(values, confidence):
    a = (1 - confidence) / 2
    return np.quantile(values, a), np.quantile(values, 1 - a), np.mean(values)


def interval(df, metric):
    r = df.where(F.col("metric") == metric).first()
    return r.low, r.high, r.mean


def weighted_auc(p, y, w):
    pos, neg = y == 1, y == 0
    wins = (p[pos][:, None] > p[neg]) + (p[pos][:, None] == p[neg]) / 2
    return (w[pos][:, None] * w[neg] * wins).sum() / (w[pos].sum() * w[neg].sum())


def test_clustered_and_auc(spark, scored):
    rows, df = scored
    R = 25
    c = counts_of(df, "sample_id", R, 9)
    y, p = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    w = np.array([c[r[3], r[0]] for r in rows])
    ok = np.where(y == 1, p >= 0.5, p < 0.5)
    got = resample.bootstrap_report(df, R, 9, 0.5, 0.8)
    recall = [(ok * w[:, k])[y == 1].sum() / w[y == 1, k].sum() for k in range(R)]
    brier = [((p - y) ** 2 * w[:, k]).sum() / w[:, k].sum() for k in range(R)]
    auc = [weighted_auc(p, y, w[:, k]) for k in range(R)]
    for name, values in (("recall", recall), ("brier", brier), ("auc", auc)):
        assert interval(got, name) == pytest.approx(limits(values, 0.8))
    assert got.count() == 5


def test_paired(spark, scored):
    rows, df = scored
    R = 20
    c = counts_of(df, "sample_id", R, 4)
    p = df.select("sample_id", "label", F.col("probability").alias("left"), F.least(F.lit(1.0), F.col("probability") + 0.1).alias("right"))
    y, x = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    z, w = np.minimum(1, x + 0.1), np.array([c[r[3], r[0]] for r in rows])
    ok = lambda q: np.where(y == 1, q >= 0.5, q < 0.5).astype(int)
    d = [((ok(z) - ok(x)) * w[:, k])[y == 0].sum() / w[y == 0, k].sum() for k in range(R)]
    assert interval(resample.paired_bootstrap(p, R, 4, 0.5, 0.9), "delta_specificity") == pytest.approx(limits(d, 0.9))


def test_group_auc(spark, scored):
    rows, df = scored
    R = 20
    b = df.withColumn("probability", 1 - F.col("probability"))
    c = counts_of(df, "group_id", R, 8)
    y, p, v = np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[2] for r in rows])
    w = np.array([c[r[3], r[1]] for r in rows])
    d = [np.mean([weighted_auc(p[v == s], y[v == s], w[v == s, k]) - weighted_auc(1 - p[v == s], y[v == s], w[v == s, k]) for s in ("clean", "web")]) for k in range(R)]
    assert interval(resample.group_auc_bootstrap(df, b, R, 8), "delta_auc") == pytest.approx(limits(d, 0.9))


def test_hierarchical_distribution(spark, scored):
    """Against row by row draws: means and deviations of the macro rates agree."""
    rows, df = scored
    ok = {}
    for _, g, _, l, p in rows:
        ok.setdefault((l, g), []).append((p >= 0.5) if l else (p < 0.5))
    rng = np.random.default_rng(1)
    groups = [np.array(v) for (l, _), v in sorted(ok.items()) if l == 1]
    want = [np.mean([rng.choice(groups[i], len(groups[i])).mean() for i in rng.integers(0, len(groups), len(groups))]) for _ in range(3000)]
    got = interval(resample.hierarchical_bootstrap(df, 3000, 2, 0.5), "macro_recall")
    assert got == pytest.approx(limits(want, 0.95), abs=0.02)
    sure = df.withColumn("probability", F.col("label").cast("double"))
    assert {tuple(r)[1:] for r in resample.hierarchical_bootstrap(sure, 9, 2, 0.5).collect()} == {(1.0, 1.0, 1.0)}


def test_input_is_read_once(spark, scored):
    """Nothing in the plan grows with the replicates: no row for each of them before a task's sums."""
    _, df = scored
    plans = [resample.clustered_bootstrap(df, R, 1, 0.5)._jdf.queryExecution().optimizedPlan().toString() for R in (10, 1000)]
    assert all(p.count("FlatMapGroupsInArrow") == 1 and "Generate explode(sequence" not in p for p in plans)


def test_one_odd_key_leaves_the_parts_even(spark):
    """200,000 ids with a long shared beginning and one of another kind."""
    ids = spark.range(200_000).select(F.format_string("img_%012d", "id").alias("k")).unionByName(spark.sql("SELECT 'abc' AS k"))
    parts = ordered.in_parts(ids, ["k"], parts=64)
    sizes = [r["count"] for r in parts.groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 3 * 200_000 / 64
    placed = ordered.places(ids, [], "k", "i")
    assert placed.where("i <> case when k = 'abc' then 0 else cast(substring(k, 5) as long) + 1 end").count() == 0


def test_teacher_gate_reads_scores_once(spark):
    """Scored rows are read for keys, groups, replicates and views; what makes them runs once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        made.add(1)
        return x

    rows = [(f"s{i}", v, i % 2, f"g{i % 8}", ((i * 37) % 100) / 100) for i in range(200) for v in ("clean", "web")]
    df = spark.createDataFrame(rows, "sample_id string, view string, label int, group_id string, p double").withColumn("probability", costly("p"))
    ranking = spark.createDataFrame([("a", True, 0.9, 1), ("b", True, 0.8, 2)], "model string, eligible boolean, macro_score double, rank int")
    curve = spark.createDataFrame([(1, 9.0), (2, 9.0)], "step int, score double")
    got = {r.gate.split(" ")[0]: r.value for r in gates.teacher_gate(ranking, "a", {"a": df, "b": df}, curve, 1.0, 20, 3).collect()}
    assert got == {"lead_macro_score": pytest.approx(0.1), "auc_low": 0, "least_view_auc_change": 0, "stable": 2}
    assert made.value == 2 * len(rows)
