"""Small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions import scalars as S
from sievemark.operators import calibration, filters, gates, integrity, joins, linear, metrics, resample, sampling, sets, slices
from sievemark.sources import manifests


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_metrics_of_four_rows(spark):
    df = rows(spark, [(i, 0, l, p) for i, (l, p) in enumerate([(0, 0.1), (0, 0.65), (1, 0.65), (1, 0.9)])], "line int, view_pos int, label int, probability double").withColumn("sample_id", F.col("line").cast("string"))
    m = metrics.binary_metrics(df.withColumn("v", F.lit(1)), ["v"], 0.65).first()
    assert (m.tp, m.tn, m.fp, m.fn) == (2, 1, 1, 0)
    assert (m.balanced_accuracy, m.auc) == (0.75, 0.875)


def test_rates_of_one_class_are_null(spark):
    df = rows(spark, [(1, 0.9), (1, 0.1)], "label int, probability double").withColumn("v", F.lit(1))
    r = metrics.rates(metrics.confusion(df, ["v"], 0.65)).first()
    assert r.specificity is None and r.balanced_accuracy is None and r.recall == 0.5
    assert metrics.roc_auc(df, ["v"]).first().auc is None


def test_empty_input_gives_no_groups(spark):
    df = rows(spark, [], "v int, label int, probability double, raw_logit double")
    assert not metrics.roc_auc(df, ["v"]).collect() and not metrics.optimal_threshold(df, ["v"]).collect()


def test_optimal_threshold(spark):
    df = rows(spark, [(0, -4.0), (0, -2.00001), (1, -2.0), (1, 7.0)], "label int, raw_logit double").withColumn("v", F.lit(1))
    r = metrics.optimal_threshold(df, ["v"]).first()
    assert (r.threshold, r.balanced) == (-2.0, 1.0)


def test_bias_maps_the_boundary_to_the_target(spark):
    df = rows(spark, [(0, -4.0), (0, -2.0), (1, 1.0), (1, 3.0)], "label int, raw_logit double").withColumn("v", F.lit(1))
    for r in calibration.fit_calibrators(df, ("bias", "platt"), 0.65, "v").collect():
        assert r.slope > 0
        assert 1 / (1 + np.exp(-(r.slope * r.boundary + r.intercept))) == pytest.approx(0.65)


def test_platt_is_the_newton_optimum(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    x = (2 * y - 1) * 0.7 + rng.normal(size=200)
    df = rows(spark, [(0, int(a), float(b)) for a, b in zip(y, x)], "k int, label int, raw_logit double")
    got = calibration.platt_slopes(df, "k")[0]
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(at[0] * x + at[1])))
        g = np.array([(w * (p - y) * x).sum() + 1e-4 * at[0], (w * (p - y)).sum() + 1e-8 * at[1]])
        h = np.array([[(w * p * (1 - p) * x * x).sum() + 1e-4, (w * p * (1 - p) * x).sum()], [(w * p * (1 - p) * x).sum(), (w * p * (1 - p)).sum() + 1e-8]])
        at = at - np.linalg.solve(h, g)
    assert got == pytest.approx(at[0], abs=1e-6)


def test_logo_needs_three_groups(spark):
    df = rows(spark, [("a", 1, "g", 1.0), ("b", 0, "h", -1.0)], "sample_id string, label int, group_id string, raw_logit double")
    with pytest.raises(ValueError, match="three"):
        calibration.select_calibrator(df, 0.65)


def test_logo_of_twelve(spark):
    data = [(f"{s}{g}{i}", l, f"{l}{g}", c + d) for l, s, cs in ((0, "r", (-4, -3, -2)), (1, "f", (2, 3, 4))) for g, c in enumerate(cs) for i, d in enumerate((-0.1, 0.1))]
    df = rows(spark, [(a, b, c, float(d)) for a, b, c, d in data], "sample_id string, label int, group_id string, raw_logit double")
    scores, final = calibration.select_calibrator(df, 0.65)
    assert max(r.macro_score for r in scores.collect()) >= 0.8 and final.count() == 1


def test_bootstrap_of_perfect_scores(spark):
    data = [(f"{l}{i}", v, l, 0.9 if l else 0.1) for l in (0, 1) for i in range(5) for v in ("clean", "web")]
    df = rows(spark, data, "sample_id string, view string, label int, probability double")
    for r in resample.clustered_bootstrap(df, 20, 1, 0.65).where("metric <> 'brier'").collect():
        assert (r.low, r.high) == (1.0, 1.0)
    assert resample.bootstrap_auc(df, 10, 1).first().low == 1.0


def test_paired_bootstrap_promotes(spark):
    data = [(f"{l}{i}", v, l, "g", i, 0.7, 0.9 if l else 0.1) for l in (0, 1) for i in range(10) for v in ("clean", "web")]
    p = rows(spark, data, "sample_id string, view string, label int, group_id string, line int, left double, right double")
    assert slices.metric_delta(p, 0.65).first().delta_balanced_accuracy == 0.5
    assert resample.paired_bootstrap(p, 20, 1, 0.65).where("metric = 'delta_balanced_accuracy'").first().promote


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    hashes = list(base) + [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base]
    data = [(f"s{i:03}", f"{int(h):016x}", ("train", "test")[i % 2 if i < 40 else (i + 1) % 2], f"c{i}") for i, h in enumerate(hashes)]
    df = rows(spark, data, "sample_id string, phash string, role string, content_sha256 string")
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[2] != b[2] and bin(int(a[1], 16) ^ int(b[1], 16)).count("1") <= 4}
    assert {(r.a, r.b) for r in joins.near_pairs(df, 4).collect()} == want and want


def test_wide_pairs_against_brute_force(spark):
    """Beyond KEYED bits: copies, upper case and bad hashes among them, in several blocks, with and without roles."""
    rng = np.random.default_rng(2)
    base = [int(h) for h in rng.integers(0, 1 << 63, 30, dtype=np.uint64)]
    hashes = [h ^ sum({1 << int(b) for b in rng.integers(0, 64, 12)}) for h in base * 8] + base[:5] * 2
    data = [(f"s{i:03}", f"{h:016x}" if i % 5 else f"{h:016X}", ("train", "test", "calibration")[i % 3], f"c{i % 200}") for i, h in enumerate(hashes)] + [("bad", "zz", "train", "x"), ("none", None, "test", "y")]
    df = rows(spark, data, "sample_id string, phash string, role string, content_sha256 string")
    one = {}
    for s, h, role, c in data[:-2]:
        one[h, role, c] = min(s, one.get((h, role, c), s))
    items = [(s, int(h, 16), role, c) for (h, role, c), s in one.items()]
    for cross in ("role", None):
        want = sorted((a[0], b[0], d) for a in items for b in items if a[0] < b[0] and a[3] != b[3] and (not cross or a[2] != b[2]) and (d := (a[1] ^ b[1]).bit_count()) <= 16)
        assert sorted(tuple(r) for r in joins.near_pairs(df, 16, cross).collect()) == want and want
    bits = df.where("phash rlike '^[0-9a-fA-F]{16}$'").select(F.expr("cast(conv(phash, 16, -10) as bigint)").alias("bits")).distinct()
    pairs = lambda block: sorted((min(r.p, r.q), max(r.p, r.q), r.distance) for r in joins.near_hashes(bits, 16, block).collect())
    assert pairs(20) == pairs(1000) and len(set(pairs(20))) == len(pairs(20))
    assert joins.near_pairs(df.limit(0), 16).count() == 0
    plan = joins.near_pairs(df, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "band#" not in plan


def test_median_is_found_once_a_row(spark):
    v = np.random.default_rng(3).normal(size=(20, 64)).round(1)
    df = rows(spark, [(x.tolist(),) for x in v], "v array<double>").select(S.median_bits(F.col("v")).alias("h"))
    assert [r.h for r in df.collect()] == [f"{int(''.join('01'[int(y >= sorted(x[1:])[31])] for y in x), 2):016x}" for x in v]
    # Not within the lambda over the elements, nor for each half of the digits: sorting is most of the work.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1 and plan.index("array_sort(") < plan.index("lambda")
    none = rows(spark, [(None,), ([1.0] * 40 + [None] * 24,)], "v array<double>").select(S.median_bits(F.col("v")).alias("h"))
    assert [r.h for r in none.collect()] == [None, "ffffffffff000000"]


def test_bad_hashes_are_counted_not_joined(spark):
    df = rows(spark, [("a", "zz", "train", "x", "g"), ("b", None, "test", "y", "h")], "sample_id string, phash string, role string, content_sha256 string, group_id string")
    assert joins.near_pairs(df, 4).count() == 0
    assert {r.code: r.n for r in integrity.hash_issues(df).collect()} == {"bad_content_hash": 2, "bad_phash": 2}


def test_audit_finds_exact_and_near(spark):
    z = "0" * 64
    df = rows(spark, [("a", "0" * 16, "train", z, "g"), ("b", "0" * 15 + "3", "test", "1" * 64, "h"), ("c", "f" * 16, "test", z, "i")], "sample_id string, phash string, role string, content_sha256 string, group_id string")
    n = {r.code: r.n for r in integrity.audit_manifest(df).collect()}
    assert n["exact_overlap"] == 1 and n["near_overlap"] == 1 and n["duplicate_sample_id"] == 0


def test_cross_role_near_rows_go(spark):
    df = rows(spark, [("t", "0" * 16, "train", "a"), ("c", "0" * 15 + "1", "calibration", "b"), ("d", "f" * 16, "calibration", "c")], "sample_id string, phash string, role string, content_sha256 string")
    assert {r.sample_id for r in integrity.drop_cross_role_near(df, 1).collect()} == {"t", "d"}


def test_caps_and_order(spark):
    data = [(s, f"{s}{i}") for s in "ab" for i in range(20)]
    pick = lambda d: {r.locator for r in sampling.capped_sample(rows(spark, d, "source string, locator string"), "source", {"a": 3, "b": 5}, 1, "locator").collect()}
    assert pick(data) == pick(data[::-1]) and len(pick(data)) == 8


def test_quota_fails_short(spark):
    df = rows(spark, [("a", "x", "h")], "source string, locator string, content_sha256 string")
    with pytest.raises(ValueError, match="quotas"):
        sampling.quota_sample(df, "source", {"a": 2}, 1, "locator")


def test_round_robin_takes_all_sources(spark):
    data = [(f"{l}{s}{i}", l, s) for l in (0, 1) for s, n in (("big", 20), ("small", 2)) for i in range(n)]
    got = sampling.round_robin_subset(rows(spark, data, "sample_id string, label int, source string"), 12, 3).collect()
    assert len(got) == 12 and {(r.label, r.source) for r in got} == {(l, s) for l in (0, 1) for s in ("big", "small")}


def test_strict_errors(spark):
    l = rows(spark, [("a", "clean")], "sample_id string, view string")
    m = rows(spark, [("b", 1, "g")], "sample_id string, label int, group_id string")
    with pytest.raises(Exception, match="not in the manifest"):
        joins.strict_lookup(l, m).collect()
    with pytest.raises(ValueError, match="keys differ"):
        joins.assert_same_keys(l, l.withColumn("view", F.lit("web")), ["sample_id", "view"])
    with pytest.raises(ValueError, match="positive"):
        filters.assert_positive_cohort(rows(spark, [("a", 0, "test")], "sample_id string, label int, role string"))


def test_manifest_scan(spark, tmp_path):
    head = "sample_id,path,label,dataset,source,group_id,role,content_sha256,phash,note"
    p = tmp_path / "m.csv"
    p.write_text(f"{head}\n a ,x/y.png,1,d,s,g,train,h,p, n \nb,/abs,2,d,s,g,train,h,p,\nc,z,0,d,s,g,dev,h,p,\n")
    ok, bad = manifests.read_manifest(spark, str(p), strict=False)
    assert [(r.sample_id, r.path, r.note) for r in ok.collect()] == [("a", f"{tmp_path}/x/y.png", "n")]
    assert {r["_problem"] for r in bad.collect()} == {"label", "role"}
    with pytest.raises(ValueError, match="2 bad rows"):
        manifests.read_manifest(spark, str(p))
    with pytest.raises(ValueError, match="empty"):
        manifests.write_manifest(ok.where("false"), str(tmp_path / "out"))


def test_malformed_ledger_line_fails(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"sample_id": "a", "view": "clean", "raw_logit": 1.5}\n\n{"sample_id": \n')
    with pytest.raises(Exception, match="malformed line"):
        manifests.read_ledger(spark, str(p)).collect()


def test_registry(spark):
    with pytest.raises(ValueError):
        manifests.load_registry(spark, {"x": {"family": "f"}}, ["x"])


def test_scalars(spark):
    d = spark.range(1)
    one = lambda c: d.select(c.alias("x")).first().x
    assert one(S.sigmoid(F.lit(-1000.0))) == 0.0 and one(S.sigmoid(F.lit(1000.0))) == 1.0
    assert one(S.effective_short(F.lit(1000), F.lit(500), F.lit("web"))) == 384
    assert one(S.resolution_bucket(F.lit("x"), F.lit("5"))) == "unknown"
    assert one(S.slug(F.lit("--a b/c--"))) == "a-b-c" and one(S.slug(F.lit(None).cast("string"))) == "unknown"
    assert one(S.label_alias(F.lit("AI"))) == 1 and one(S.label_alias(F.lit("what"))) is None
    assert one(S.hamming(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert one(S.wilson(F.lit(0), F.lit(0))[0]) is None
    with pytest.raises(Exception, match="bytes differ"):
        one(S.assert_bytes(F.lit("a").cast("binary"), F.lit("0" * 64)))


def test_sets(spark):
    a, b = rows(spark, [(1, "x")], "k int, view string"), rows(spark, [(2, 5)], "k int, n int")
    assert sets.union_manifests(a, b).columns == ["k", "view", "n"]
    assert [r.family for r in sets.missing_families(rows(spark, [("a",)], "family string"), ["a", "b"]).collect()] == ["b"]


def test_gate_of_null_fails(spark):
    g = gates.gates(spark.range(1).select(F.lit(None).cast("double").alias("x")), [("x", ">=", 0.5)])
    assert not g.first().passed and not gates.valid(g).first().valid


def test_scoring_keeps_errors(spark):
    df = rows(spark, [("a", "clean", 1.0), ("b", "clean", None)], "sample_id string, view string, x double")

    def fn(s):
        if s.isna().any():
            raise ValueError("null")
        return s * 2

    got = {r.sample_id: (r.raw_logit, r.error) for r in linear.score_to_ledger(df, fn, "x", "m").collect()}
    assert got["a"] == (2.0, None) and got["b"][1].startswith("ValueError")


# -- reports and gates, by the cases of the reference's own tests


def canary_tables(spark, **change):
    run = {"losses": [1.0, 0.9, 0.8, 0.7, 0.6, 0.5], "gradients": [5.0] * 6, "scores": [0.6, 0.7, 0.65], "failures": 0} | change
    curve = [("r", i + 1, x, g) for i, (x, g) in enumerate(zip(run["losses"], run["gradients"]))]
    return (
        spark.createDataFrame(curve, "run_id string, step int, loss double, gradient_norm double"), spark.createDataFrame([("r", 10 * i, x) for i, x in enumerate(run["scores"])], "run_id string, step int, macro_score double"),
        spark.createDataFrame([("r", run["failures"], 6, 288, True)], "run_id string, decode_failures int, steps int, samples int, eligible boolean"),
    )


@pytest.mark.parametrize(("change", "failed"), [
    ({}, None), ({"losses": [1.0, 1.0, 1.0, 1.2, 1.2, 1.2]}, "loss_not_worse"), ({"losses": [1.0, 1.0, 1.0, 1.1, 1.1, 1.1]}, None), ({"gradients": [5.0, 5.0, 5.0, 5.0, 100.0, 100.0]}, "gradient_bounded"), ({"gradients": [900.0] + [5.0] * 20, "losses": [1.0] * 21}, None),
    ({"scores": [0.6, 0.7, 0.58]}, "validation_not_worse"), ({"failures": 1}, "no_decode_failures"), ({"losses": [1.0, 0.9, float("nan"), 0.7, 0.6, 0.5]}, "finite"),
])
def test_curve_checks(spark, change, failed):
    r = slices.curve_health(*canary_tables(spark, **change)).first()
    assert [c for c in slices.CHECKS if not r[c]] == ([failed] if failed else []) and r.healthy == (failed is None)
    s = sampling.canary_summary(slices.curve_health(*canary_tables(spark, **change))).first()
    assert (s.healthiest, s.recommended, s.best_validation) == ((None,) * 3 if failed else ("r",) * 3) and s.equal_steps


def test_short_curves_fail(spark):
    for change in ({"losses": [1.0] * 5, "gradients": [1.0] * 5}, {"scores": [0.5, 0.6]}):
        with pytest.raises(Exception, match="incomplete curve"):
            slices.curve_health(*canary_tables(spark, **change)).collect()


def rank_rows(spark, reverse=False):
    rows = [(f"r{i}", "clean", -3.0, 0, "real") for i in range(30)] + [(f"f{g}{i}", "clean", 3.0, 1, f"fake{g}") for g in range(3) for i in range(10)]
    manifest = spark.createDataFrame([(s, y, g, "calibration") for s, _, _, y, g in rows], "sample_id string, label int, group_id string, role string")
    ledger = spark.createDataFrame([(s, v, -x if reverse else x, None) for s, v, x, _, _ in rows], "sample_id string, view string, raw_logit double, error string")
    return manifest, ledger


def test_tournament_ranks_eligible_first(spark):
    manifest, good = rank_rows(spark)
    _, bad = rank_rows(spark, True)
    rows = {r.model: r for r in gates.rank_tournament(manifest, {"good": good, "bad": bad}, 0.65, {"good": True}).collect()}
    assert rows["good"].rank == 1 and rows["good"].eligible and not rows["bad"].eligible
    assert rows["good"].macro_score == 1.0 and rows["good"].auc == 1.0 and rows["bad"].auc == 0.0
    with pytest.raises(Exception, match="no eligible candidate"):
        gates.rank_tournament(manifest, {"good": good}, 0.65, {}).collect()
    with pytest.raises(Exception, match="not in the manifest"):
        gates.rank_tournament(manifest.where("sample_id <> 'r3'"), {"good": good}, 0.65, {"good": True}, ("identity",)).collect()


def test_report_needs_all_predictions(spark):
    roles = [(role, y, f"{role}{y}{g}") for role in ("calibration", "test") for y in (0, 1) for g in range(3)]
    rows = [(f"{g}{i}", y, g, role) for role, y, g in roles for i in range(3)]
    manifest = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "sample_id string, label int, group_id string, role string, line int")
    ledger = spark.createDataFrame([(s, v, k, 3.0 if y else -3.0, None) for s, y, _, _ in rows for k, v in enumerate(("clean", "web"))], "sample_id string, view string, view_pos int, raw_logit double, error string")
    audit = spark.createDataFrame([("duplicate_sample_id", 0, "error"), ("near_overlap", 2, "warning")], "code string, n int, severity string")
    got = {r.gate.split()[0]: r for r in gates.evaluation_report(manifest, ledger, audit, ["clean", "web"], 0.65, 20, 1)["gates"].collect()}
    assert got["manifest_errors"].passed and got["balanced_accuracy"].value == 1.0 and got["class_support"].value == 9 and not got["class_support"].passed
    with pytest.raises(Exception, match="missing predictions"):
        gates.evaluation_report(manifest, ledger.where("sample_id <> 'test010' or view <> 'web'"), audit, ["clean", "web"], 0.65, 20, 1)["gates"].collect()
