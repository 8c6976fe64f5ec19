"""Gate tables and the reports that end in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import written
from . import calibration as C
from . import filters as P
from . import joins as J
from . import metrics as M
from . import resample as X
from . import sampling as W
from . import slices as G


def gates(values: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """(gate, value, bound, passed) from a row of values and (column, >=, > or <=, bound); a null value doesn't pass."""
    holds = {">=": lambda c, b: F.col(c) >= b, ">": lambda c, b: F.col(c) > b, "<=": lambda c, b: F.col(c) <= b}
    rows = [F.struct(F.lit(f"{c} {op} {b:g}").alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(holds[op](c, b), F.lit(False)).alias("passed")) for c, op, b in bounds]
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def valid(table: DataFrame) -> DataFrame:
    return table.agg(F.bool_and("passed").alias("valid"))


def one(*rows: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out


def evaluation_report(
    manifest: DataFrame, ledger: DataFrame, audit: DataFrame, views: list[str], target: float, replicates: int, seed: int,
    support: int = 100, balanced_accuracy: float = 0.75, ci_width: float = 0.08,
) -> dict[str, DataFrame]:
    """Tables of the report: calibration on calibration rows, everything else on test rows, and the gates. audit is audit_manifest()'s.

    Expected predictions that are missing fail when the tables are read. Support counts the manifest's test rows of the rarer class."""
    cal, missing_cal = J.coverage_join(manifest, ledger, "calibration", views)
    test, missing_test = J.coverage_join(manifest, ledger, "test", views)
    missing = missing_cal.unionByName(missing_test).agg(F.count(F.lit(1)).alias("missing"))
    complete = F.when(F.col("missing") > 0, F.raise_error(F.concat(F.lit("missing predictions: "), F.col("missing").cast("string"))).cast("long")).otherwise(F.col("missing"))
    test = test.crossJoin(missing.select(complete.alias("missing"))).where("missing = 0").drop("missing")  # one row
    scores, final = C.select_calibrator(cal, target)
    scored = C.apply_calibrator(test, final, target)
    ci = X.clustered_bootstrap(scored, replicates, seed, target)
    overall = M.rates(M.confusion(scored, [], target)).select("balanced_accuracy")
    width = ci.where("metric = 'balanced_accuracy'").select((F.col("high") - F.col("low")).alias("ci_width"))
    tests = manifest.where("role = 'test'").agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("class_support"))
    values = one(audit_errors(audit).withColumnRenamed("errors", "manifest_errors"), tests, overall, width)
    return {
        "calibrators": scores, "calibrator": final, "views": M.view_metrics(scored, target), "groups": G.group_view_rates(scored, target), "tail": G.macro_group_tail(scored, target)[0],
        "stress": G.paired_stress(scored, views[0], views[1:], target), "intervals": ci,
        "gates": gates(values, [("manifest_errors", "<=", 0), ("class_support", ">=", support), ("balanced_accuracy", ">=", balanced_accuracy), ("ci_width", "<=", ci_width)]),
    }


def redteam_report(
    rows: DataFrame, problems: DataFrame, calibrator: DataFrame, threshold: float, critical: list[str], family: Column, required: list[str], replicates: int, seed: int,
    worst: float = 0.75, critical_recall: float = 0.60,
) -> dict[str, DataFrame]:
    """Cases, families, worst variants with their intervals, and gates. rows have raw_logit, scored by the calibrator here; `problems` is what protocol_join() found.

    Without critical cases their gate passes."""
    from .sets import missing_families

    scored = C.apply_calibrator(rows, calibrator, threshold)
    cases = G.attack_cases(scored, threshold).withColumn("family", family)
    lowest = G.worst_case(cases, critical)
    counts = one(lowest, problems.agg(F.count(F.lit(1)).alias("protocol_problems")), missing_families(cases, required).agg(F.count(F.lit(1)).alias("missing_families")))
    bounds = [("protocol_problems", "<=", 0), ("worst_balanced_accuracy", ">=", worst), ("critical_recall", ">=", critical_recall), ("missing_families", "<=", 0)]
    none = F.col("gate").startswith("critical_recall") & F.col("value").isNull()
    table = gates(counts, bounds).withColumn("passed", F.col("passed") | none) if not critical else gates(counts, bounds)
    variants = G.worst_variant(scored)
    grouped = variants.join(scored.select("sample_id", "view", "group_id"), ["sample_id", "view"])
    return {
        "cases": cases, "families": G.family_rollup(cases), "worst": variants, "intervals": X.hierarchical_bootstrap(grouped, replicates, seed, threshold),
        "success": G.attack_success(scored, threshold), "gates": table,
    }


def compare(a: DataFrame, b: DataFrame, threshold: float, replicates: int, seed: int) -> dict[str, DataFrame]:
    """Champion a against challenger b on the keys of both; assert_same_keys() is for those who demand equal keys."""
    p = J.pair(a, b)
    return {"overall": G.metric_delta(p, threshold), "groups": G.group_delta(p, threshold), "intervals": X.paired_bootstrap(p, replicates, seed, threshold)}


def rank_tournament(manifest: DataFrame, ledgers: dict[str, DataFrame], target: float, eligible: dict[str, bool], methods: tuple[str, ...] = C.METHODS) -> DataFrame:
    """Models by the macro score of held-out groups, then raw AUC, both on the manifest's rows of role `calibration`; eligible models come first, and without one it fails.

    Each model gets its own calibrator, chosen by leave-one-group-out; its slope and intercept after a fit on all rows come along. A prediction of a sample that isn't a calibration row fails."""
    tables = [l.where("error is null and raw_logit is not null").withColumn("model", F.lit(name)) for name, l in ledgers.items()]
    rows = J.strict_lookup(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), manifest.where("role = 'calibration'"))
    out = []
    for model, found in C.select_calibrators(rows, "model", target, methods).items():
        final = found["final"]
        best = next(r for r in found["scores"] if r["method"] == final["method"])
        out.append(best | final | {"model": model, "auc": found["auc"], "calibrator": final["method"], "pooled_balanced_accuracy": best["balanced_accuracy"], "eligible": bool(eligible.get(model))})
    kinds = "macro_score double, pooled_balanced_accuracy double, log_loss double, calibrator string, slope double, intercept double, model string, auc double, eligible boolean"
    return W.rank_candidates(C.local(manifest.sparkSession, out, kinds))


def change(base: DataFrame, new: DataFrame, where: Column, prefix: str) -> DataFrame:
    """One row: macro view metrics of new less base."""
    x, y = G.macro_views(base, where), G.macro_views(new, where)
    names = [c for c in x.columns if c != "views"]
    return x.select(*[F.col(c).alias(f"_{c}") for c in names]).crossJoin(y).select(*[(F.col(c) - F.col(f"_{c}")).alias(f"{prefix}_{c.removeprefix('macro_')}") for c in names])  # one row each


def ablation_gates(base: DataFrame, new: DataFrame, low_quality: Column, critical: Column, gain: float = 0.05, recall_gain: float = 0.08, clean_loss: float = 0.01, specificity_loss: float = 0.03) -> DataFrame:
    """base and new: view metrics. Low-quality and critical views must gain, the clean view and specificity may lose little."""
    values = one(change(base, new, low_quality, "low_quality"), change(base, new, critical, "critical"), change(base, new, F.col("view") == "clean", "clean"))
    bounds = [("low_quality_balanced_accuracy", ">=", gain), ("critical_balanced_accuracy", ">=", gain), ("low_quality_recall", ">=", recall_gain), ("clean_balanced_accuracy", ">=", -clean_loss), ("low_quality_specificity", ">=", -specificity_loss)]
    return gates(values, bounds)


def promotion_gates(
    base: DataFrame, new: DataFrame, low_base: DataFrame, low_new: DataFrame, cohorts: dict[str, tuple[DataFrame, DataFrame]], families_base: DataFrame, families_new: DataFrame, family: str, parity: DataFrame,
    view_loss: float = 0.01, low_gain: float = 0.08, recall_gain: float = 0.15, family_gain: float = 0.05, disagreement: float = 0.005,
) -> DataFrame:
    """base and new: metrics of the standard views clean, web and hard; low_base, low_new: of low-quality views; cohorts: by name, positive_summary() by view of a protected cohort
    before and after, whose mean recall must not fall; families: family_rollup() of both; parity: ledger_parity() of the exported model."""
    every = F.lit(True)
    parts = [change(base, new, F.col("view") == v, v).select(f"{v}_balanced_accuracy") for v in ("clean", "web", "hard")]
    parts.append(change(low_base, low_new, every, "low_quality").select("low_quality_balanced_accuracy", "low_quality_recall"))
    recall = lambda t, name: t.agg(F.avg("recall").alias(name))
    for name, (x, y) in cohorts.items():
        parts.append(one(recall(x, "_x"), recall(y, "_y")).select((F.col("_y") - F.col("_x")).alias(f"{name}_recall")))
    lowest = lambda t, name: t.where(F.col("family") == family).agg(F.min("worst_balanced_accuracy").alias(name))
    parts.append(one(lowest(families_base, "_x"), lowest(families_new, "_y")).select((F.col("_y") - F.col("_x")).alias("family_balanced_accuracy")))
    parts.append(parity.select("disagreement_rate"))
    bounds = [(f"{v}_balanced_accuracy", ">=", -view_loss) for v in ("clean", "web", "hard")] + [("low_quality_balanced_accuracy", ">=", low_gain), ("low_quality_recall", ">=", recall_gain)]
    bounds += [(f"{name}_recall", ">=", 0.0) for name in cohorts] + [("family_balanced_accuracy", ">=", family_gain), ("disagreement_rate", "<=", disagreement)]
    return gates(one(*parts), bounds)


def teacher_gate(
    ranking: DataFrame, teacher: str, ledgers: dict[str, DataFrame], validations: DataFrame, best: float, replicates: int, seed: int,
    margin: float = 0.01, view_loss: float = 0.005, stable: int = 2,
) -> DataFrame:
    """The teacher against the eligible other model of best macro score: a margin in macro score, an AUC interval above 0, no view whose AUC falls by more than view_loss, and
    validations that stay over the student's best. ledgers: scored rows by model; fails where there is no eligible student."""
    student = ranking.where((F.col("model") != teacher) & F.col("eligible")).orderBy(F.desc("macro_score"), "rank").select("model").first()  # a row per model
    if student is None:
        raise ValueError("no eligible student")
    # Both are read for the keys, the groups, the replicates and the views.
    a, b = (written(ledgers[m].select("sample_id", "view", "label", "group_id", "probability"), "gate-rows") for m in (teacher, student[0]))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_score")))
    lead = ranking.agg((pick(teacher) - pick(student[0])).alias("lead_macro_score"))
    keys = written(J.common_support(a, b), "gate-keys")
    ci = X.group_auc_bootstrap(a.join(keys, ["sample_id", "view"], "left_semi"), b.join(keys, ["sample_id", "view"], "left_semi"), replicates, seed).agg(F.max("low").alias("auc_low"))
    views = M.roc_auc(a, ["view"]).join(M.roc_auc(b, ["view"]).withColumnRenamed("auc", "_auc"), "view").agg(F.min(F.col("auc") - F.col("_auc")).alias("least_view_auc_change"))
    return gates(one(lead, ci, views, G.stable_count(validations, best)), [("lead_macro_score", ">=", margin), ("auc_low", ">", 0), ("least_view_auc_change", ">=", -view_loss), ("stable", ">=", stable)])


DETAILS = {"model_slug": "", "prompt": "", "seed": ""}
"""What a cohort report takes over from the attempts that made the samples, and what stands where there is none."""


def positive_cohort_report(manifest: DataFrame, attempts: DataFrame, ledger: DataFrame, calibrator: DataFrame, base: str, stress: list[str], threshold: float) -> dict[str, DataFrame]:
    """Tables of a cohort of positives under a frozen calibrator. Fails unless the manifest has positive test rows only, each once, and the ledger exactly one valid prediction for each of their views.

    Details come from the last successful attempt of a sample's content; sources go without the prefix of hosted models."""
    P.assert_positive_cohort(manifest)
    keys = ["sample_id", "view"]
    J.assert_same_keys(J.expected_keys(manifest, [base, *stress]).select(*keys), ledger.select(*keys), keys)
    bad = ledger.agg(F.count_if(F.col("raw_logit").isNull() | F.col("error").isNotNull()).alias("failed"), (F.count(F.lit(1)) - F.count_distinct(*keys)).alias("repeated")).first()
    if any(bad):
        raise ValueError(f"not one valid prediction for each view: {bad.asDict()}")
    rows = J.enrich(manifest.withColumn("source", S.source_name(F.col("source"))), attempts, "content_sha256", DETAILS, "seq")
    scored = C.apply_calibrator(ledger.select(*keys, "raw_logit", "view_pos").join(rows, "sample_id"), calibrator, threshold)
    return {
        "rows": scored.select(*keys, "source", *DETAILS, "raw_logit", "probability", (F.col("probability") >= threshold).alias("detected")),
        "views": G.positive_summary(scored, ["view"], threshold), "sources": G.positive_summary(scored, ["source", "view"], threshold), "detected": G.all_any_detected(scored, threshold, ["source"]),
        "transitions": G.transitions(scored, base, stress, threshold), "misses": W.misses(scored, base, threshold),
    }


def final_summary(scored: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """One row: worst view, metrics of each sample's worst variant, share of positives found on all views, and parity with the second ledger."""
    worst = M.view_metrics(scored, threshold).agg(F.min_by("view", F.struct("balanced_accuracy", "view")).alias("worst_view"), F.min("balanced_accuracy").alias("worst_balanced_accuracy"))
    robust = M.view_metrics(G.worst_variant(scored).withColumn("view", F.lit("worst")), threshold)
    robust = robust.select(*[F.col(c).alias(f"robust_{c}") for c in ("balanced_accuracy", "recall", "specificity", "auc")])
    return one(worst, robust, G.all_any_detected(scored.where("label = 1"), threshold, []).select("samples", "all_views", "any_view"), G.ledger_parity(scored, other, 1.0, 0.6, threshold).select("disagreement_rate"))


def audit_errors(audit: DataFrame) -> DataFrame:
    return audit.agg(F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0)).alias("errors"))


def audit_gate(audit: DataFrame) -> DataFrame:
    return gates(audit_errors(audit), [("errors", "<=", 0)])
