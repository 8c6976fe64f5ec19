"""Slices, group tails, worst cases and cohort summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import metrics as M


def slices(df: DataFrame, fields: list[str], threshold: float, minimum: int = 20) -> DataFrame:
    """(field, value, ...) metrics of each value of each field, given `minimum` rows and both classes. Rows are exploded once per field, not scanned again."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    each = df.select("sample_id", "label", "probability", "line", "view_pos", pairs.alias("_fv")).select("*", "_fv.field", "_fv.value").drop("_fv")
    by = ["field", "value"]
    enough = M.confusion(each, by, threshold).where((F.col("n") >= minimum) & (F.col("n_real") > 0) & (F.col("n_fake") > 0)).select(*by)
    return M.binary_metrics(each, by, threshold).join(enough, by)


SHORT_EDGE = 440
"""What models resize to where their ledger doesn't say."""


def resolution_buckets(df: DataFrame, threshold: float) -> DataFrame:
    """By view, resolution bucket, scale bucket and label, of rows that have dimensions; missing_dimensions() counts the others. The target of the resize is each row's
    model_resize_short_edge, where df has one; a bucket gives that of its first row by `line`."""
    w, h = (F.col(c).try_cast("long") for c in ("width", "height"))
    target = F.coalesce(F.col("model_resize_short_edge").try_cast("long"), F.lit(SHORT_EDGE)) if "model_resize_short_edge" in df.columns else F.lit(SHORT_EDGE)
    rows = df.where(w.isNotNull() & h.isNotNull()).withColumns({
        "bucket": S.resolution_bucket(w, h), "_short": F.least(w, h), "_target": target.cast("long"), "_ok": S.correct(F.col("label"), F.col("probability"), threshold).cast("int"),
        "_effective": S.effective_short(w, h, F.col("view")),
    }).withColumn("scale", S.scale_bucket(F.col("_target"), F.col("_effective")))
    return rows.groupBy("view", "bucket", "scale", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("unique_images"), F.avg("_ok").alias("rate"), F.avg("probability").alias("mean_p"),
        F.avg("_short").alias("mean_original_short"), F.avg("_effective").alias("mean_short"), F.min_by("_target", "line").alias("short_edge"), F.avg(F.col("_target") / F.col("_effective")).alias("mean_factor"),
        F.array_join(F.sort_array(F.collect_set("group_id")), ",").alias("groups"),
    ).withColumn("metric", F.when(F.col("label") == 1, "fake_recall").otherwise("real_specificity"))


def missing_dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("width").try_cast("long").isNull() | F.col("height").try_cast("long").isNull()).alias("missing_dimensions"))


def group_view_rates(df: DataFrame, threshold: float, by: tuple[str, ...] = ("view", "group_id", "label")) -> DataFrame:
    ok = S.correct(F.col("label"), F.col("probability"), threshold).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("rate"))


def macro_group_tail(df: DataFrame, threshold: float, worst: int = 10) -> tuple[DataFrame, DataFrame]:
    """(label, macro_rate, p10) and the `worst` groups of each class (label, place, group_id, rate)."""
    g = group_view_rates(df, threshold, ("label", "group_id"))
    tail = g.groupBy("label").agg(F.avg("rate").alias("macro_rate"), F.percentile("rate", 0.1).alias("p10"), F.count(F.lit(1)).alias("groups"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("rate", "group_id"))
    return tail, g.withColumn("place", place).where(F.col("place") <= worst).select("label", "place", "group_id", "rate")


def macro_score(df: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over classes of the mean group rate; a class that is absent is skipped."""
    g = group_view_rates(df, threshold, (*by, "label", "group_id"))
    return g.groupBy(*by, "label").agg(F.avg("rate").alias("_r")).groupBy(*by).agg(F.avg("_r").alias("macro_score"))


def paired_stress(df: DataFrame, base: str, stresses: list[str], threshold: float) -> DataFrame:
    """Each stress view against the base view of the same sample: mean change, flips, change of rates."""
    b = df.where(F.col("view") == base).select("sample_id", "label", F.col("probability").alias("p0"))
    s = df.where(F.col("view").isin(stresses)).select("sample_id", "view", F.col("probability").alias("p1"))
    d, h0, h1 = F.col("p1") - F.col("p0"), F.col("p0") >= threshold, F.col("p1") >= threshold
    ok = lambda p, l: F.avg(F.when(F.col("label") == l, S.correct(F.col("label"), F.col(p), threshold).cast("int")))
    out = b.join(s, "sample_id").groupBy("view").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_delta"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.avg((h0 != h1).cast("int")).alias("flip_rate"),
        (ok("p1", 1) - ok("p0", 1)).alias("delta_recall"), (ok("p1", 0) - ok("p0", 0)).alias("delta_specificity"),
    )
    return out.withColumn("delta_balanced_accuracy", (F.col("delta_recall") + F.col("delta_specificity")) / 2)


def group_delta(paired: DataFrame, threshold: float) -> DataFrame:
    """(group_id, label, n, left_rate, right_rate, delta) of paired rows (label, group_id, left, right, line); the label of the group's first row."""
    ok = lambda p: F.avg(S.correct(F.col("label"), F.col(p), threshold).cast("int"))
    g = paired.groupBy("group_id").agg(F.min_by("label", "line").alias("label"), F.count(F.lit(1)).alias("n"), ok("left").alias("left_rate"), ok("right").alias("right_rate"))
    return g.withColumn("delta", F.col("right_rate") - F.col("left_rate"))


def metric_delta(paired: DataFrame, threshold: float) -> DataFrame:
    """One row: right minus left of balanced accuracy, recall, specificity, AUC and Brier score."""
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("probability")), F.struct(F.lit("right").alias("side"), F.col("right").alias("probability"))))
    long = paired.select("label", sides.alias("s")).select("label", "s.*")
    m = M.rates(M.confusion(long, ["side"], threshold)).join(M.roc_auc(long, ["side"]), "side").join(M.proper_scores(long, ["side"]), "side")
    names = ["balanced_accuracy", "recall", "specificity", "auc", "brier"]
    return m.agg(*[(F.max(F.when(F.col("side") == "right", F.col(c))) - F.max(F.when(F.col("side") == "left", F.col(c)))).alias(f"delta_{c}") for c in names])


def attach_clean(df: DataFrame, base: str = "clean") -> DataFrame:
    """df with the probability of the sample's base view; a window by sample, no join."""
    return df.withColumn("clean_p", F.max(F.when(F.col("view") == base, F.col("probability"))).over(Window.partitionBy("sample_id")))


def attack_cases(df: DataFrame, threshold: float, base: str = "clean") -> DataFrame:
    """Per view: rates, success among positives detected clean, change from clean."""
    rows = attach_clean(df, base).where(F.col("clean_p").isNotNull())
    hit = F.when((F.col("label") == 1) & (F.col("clean_p") >= threshold), (F.col("probability") < threshold).cast("int"))
    d = F.col("probability") - F.col("clean_p")
    return M.rates(rows.groupBy("view").agg(*M.confusion_columns(threshold), F.avg(hit).alias("attack_success"), F.avg(d).alias("mean_delta"), F.avg(F.abs(d)).alias("mean_abs_delta")))


def family_rollup(cases: DataFrame) -> DataFrame:
    return cases.groupBy("family").agg(
        F.count(F.lit(1)).alias("cases"), F.min("balanced_accuracy").alias("worst_balanced_accuracy"), F.min("recall").alias("worst_recall"), F.min("specificity").alias("worst_specificity")
    )


def worst_variant(df: DataFrame) -> DataFrame:
    """Per sample the view that hurts most: the lowest p of a positive, the highest of a negative; the first of equals."""
    hurt = F.when(F.col("label") == 1, F.col("probability")).otherwise(-F.col("probability"))
    worst = F.min_by(F.struct("view", "probability"), F.struct(hurt, "view_pos"))
    return df.groupBy("sample_id", "label").agg(worst.alias("w")).select("sample_id", "label", F.col("w.view").alias("view"), F.col("w.probability").alias("probability"))


def attack_success(df: DataFrame, threshold: float, base: str = "clean") -> DataFrame:
    """One row: samples right on the base view, and how many of those some other view turns; null rates where there are none."""
    other = F.col("view") != base
    per = df.groupBy("sample_id", "label").agg(
        F.max(F.when(~other, F.col("probability"))).alias("p0"), F.min(F.when(other, F.col("probability"))).alias("low"), F.max(F.when(other, F.col("probability"))).alias("high")
    )
    fake, real = (F.col("label") == 1) & (F.col("p0") >= threshold), (F.col("label") == 0) & (F.col("p0") < threshold)
    s = per.agg(F.count_if(fake).alias("clean_detected"), F.count_if(fake & (F.col("low") < threshold)).alias("evaded"), F.count_if(real).alias("clean_passed"), F.count_if(real & (F.col("high") >= threshold)).alias("false_positives"))
    return s.withColumn("evasion_rate", F.try_divide("evaded", "clean_detected")).withColumn("false_positive_rate", F.try_divide("false_positives", "clean_passed"))


def worst_case(cases: DataFrame, critical: list[str], base: str = "clean") -> DataFrame:
    """One row: the worst non-base case by balanced accuracy, and the lowest recall of critical cases."""
    c = cases.where(F.col("view") != base)
    return c.agg(F.min_by("view", F.struct("balanced_accuracy", "view")).alias("worst_view"), F.min("balanced_accuracy").alias("worst_balanced_accuracy"), F.min(F.when(F.col("view").isin(critical), F.col("recall"))).alias("critical_recall"))


def all_any_detected(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    per = df.groupBy(*by, "sample_id").agg(F.bool_and(F.col("probability") >= threshold).alias("a"), F.bool_or(F.col("probability") >= threshold).alias("o"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("a").cast("int")).alias("all_views"), F.avg(F.col("o").cast("int")).alias("any_view"))


def positive_summary(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Counts, recall with its Wilson interval, and the spread of p: population deviation, interpolated quantiles."""
    q = F.percentile("probability", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    s = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("probability") >= threshold).alias("detected"), F.avg("probability").alias("mean_p"),
        F.stddev_pop("probability").alias("std_p"), F.min("probability").alias("min_p"), F.max("probability").alias("max_p"), q.alias("q"),
    )
    low, high = S.wilson(F.col("detected"), F.col("n"))
    names = ("p05", "p25", "p50", "p75", "p95")
    return s.withColumns({"recall": F.col("detected") / F.col("n"), "recall_low": low, "recall_high": high} | {n: F.col("q")[i] for i, n in enumerate(names)}).drop("q")


def transitions(df: DataFrame, base: str, views: list[str], threshold: float) -> DataFrame:
    b = df.where(F.col("view") == base).select("sample_id", F.col("probability").alias("p0"))
    s = df.where(F.col("view").isin(views)).select("sample_id", "view", F.col("probability").alias("p1"))
    was, now = F.col("p0") >= threshold, F.col("p1") >= threshold
    d = F.col("p1") - F.col("p0")
    return b.join(s, "sample_id").groupBy("view").agg(
        F.count_if(was & ~now).alias("detected_to_missed"), F.count_if(~was & now).alias("missed_to_detected"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta")
    )


def ledger_parity(a: DataFrame, b: DataFrame, slope: float, intercept: float, threshold: float) -> DataFrame:
    """One row: how far the logits of two ledgers with equal keys lie apart, and how often the decision differs."""
    j = a.select("sample_id", "view", F.col("raw_logit").alias("x")).join(b.select("sample_id", "view", F.col("raw_logit").alias("y")), ["sample_id", "view"])
    differs = (S.calibrate(F.col("x"), slope, intercept) >= threshold) != (S.calibrate(F.col("y"), slope, intercept) >= threshold)
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_delta"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_delta"), F.count_if(differs).alias("disagreements"), F.avg(differs.cast("int")).alias("disagreement_rate"))


def macro_views(metrics: DataFrame, where: Column) -> DataFrame:
    """One row: unweighted means of view metrics."""
    return metrics.where(where).agg(F.count(F.lit(1)).alias("views"), *[F.avg(c).alias(f"macro_{c}") for c in ("balanced_accuracy", "recall", "specificity", "auc")])


def role_summary(manifest: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """One row per role of the fixed list, empty ones too."""
    names = manifest.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    per = manifest.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label") == 1).alias("fake"), F.count_distinct("group_id").alias("groups"))
    return names.join(per, "role", "left").na.fill(0, ["n", "real", "fake", "groups"])


def composition(df: DataFrame, keys: list[str], rollup: bool = False) -> DataFrame:
    return (df.rollup(*keys) if rollup else df.groupBy(*keys)).agg(F.count(F.lit(1)).alias("n"))


def standardized_difference(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, difference): mean of class 1 less that of class 0, over the population deviation; 0 where that is nearly 0."""
    long = df.select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("f")).select("label", "f.*")
    s = F.stddev_pop("x")
    d = F.avg(F.when(F.col("label") == 1, F.col("x"))) - F.avg(F.when(F.col("label") == 0, F.col("x")))
    return long.groupBy("feature").agg(F.when(s > 1e-12, F.try_divide(d, s)).otherwise(0.0).alias("difference"))


CHECKS = ("finite", "no_decode_failures", "loss_not_worse", "gradient_bounded", "validation_not_worse")


def curve_health(curves: DataFrame, validations: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run of curves (run_id, step, loss, gradient_norm), validations (run_id, step, macro_score) and runs (run_id, decode_failures, ...): medians of the first and last three
    losses, their relative change, slope per 100 steps, spread of the last half, p95 and maximum of the gradient, first, last and best validation, the five CHECKS, and `healthy`, if all hold.

    A run of less than six losses or three validations fails. Losses and gradients that are null or not finite fail the first check."""
    w = Window.partitionBy("run_id")
    r = curves.withColumn("k", F.row_number().over(w.orderBy("step"))).withColumn("n", F.count(F.lit(1)).over(w))
    r = r.withColumn("g", F.row_number().over(w.orderBy("gradient_norm", "step")))
    tail = F.when(F.col("k") > F.floor(F.col("n") / 2), F.col("loss"))
    r = r.withColumn("mid", F.median(tail).over(w))
    spread = F.median(F.when(F.col("k") > F.floor(F.col("n") / 2), F.abs(F.col("loss") - F.col("mid"))))
    p95 = F.max(F.when(F.col("g") == F.bround((F.col("n") - 1) * 0.95).cast("int") + 1, F.col("gradient_norm")))
    finite = lambda c: F.bool_and(F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False)))
    c = r.groupBy("run_id").agg(
        F.max("n").alias("points"), F.median(F.when(F.col("k") <= 3, F.col("loss"))).alias("first_loss"), F.median(F.when(F.col("k") > F.col("n") - 3, F.col("loss"))).alias("last_loss"),
        F.coalesce(F.regr_slope("loss", "step") * 100, F.lit(0.0)).alias("slope_100"), spread.alias("tail_mad"), p95.alias("gradient_p95"), F.max("gradient_norm").alias("gradient_max"), (finite("loss") & finite("gradient_norm")).alias("finite"),
    )
    v = validations.groupBy("run_id").agg(F.count(F.lit(1)).alias("validations"), F.min_by("macro_score", "step").alias("first_score"), F.max_by("macro_score", "step").alias("last_score"), F.max("macro_score").alias("best_score"))
    short = (F.col("points") < 6) | (F.coalesce("validations", F.lit(0)) < 3)
    long = F.when(short, F.raise_error(F.concat(F.lit("incomplete curve: "), F.col("run_id").cast("string"))).cast("long")).otherwise(F.col("points"))
    out = c.join(v, "run_id", "left").withColumn("points", long).join(runs, "run_id")
    out = out.withColumns({
        "loss_reduction": (F.col("first_loss") - F.col("last_loss")) / F.greatest("first_loss", F.lit(1e-12)), "no_decode_failures": F.col("decode_failures") == 0, "loss_not_worse": F.col("last_loss") <= F.col("first_loss") * 1.10,
        "gradient_bounded": F.col("gradient_p95") < 100.0, "validation_not_worse": F.col("last_score") >= F.col("first_score") - 0.01,
    })
    every = F.lit(True)
    for check in CHECKS:
        every = every & F.coalesce(check, F.lit(False))
    return out.withColumn("healthy", every)


def stable_count(validations: DataFrame, best: float, margin: float = 0.005) -> DataFrame:
    return validations.agg(F.count_if((F.col("step") > 0) & (F.col("score") >= best + margin)).alias("stable"))
