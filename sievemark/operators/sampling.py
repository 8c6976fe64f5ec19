"""Deterministic samples, folds and rankings. All orders come from hashes and keys, so results don't depend on input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import exclude_hashes
from .ordered import attach, first_k, in_parts, numbered


def capped_sample(df: DataFrame, key: str, caps: dict[str, int], seed: int, locator: str, default: int = 0) -> DataFrame:
    """For each key its `caps[key]` rows of lowest hash priority; of equal priorities the larger locator. Spark's window group limit drops the rest before the shuffle."""
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(key)), F.lit(default)) if caps else F.lit(default)
    prio = S.priority(str(seed), F.col(key), F.col(locator))
    order = Window.partitionBy(key).orderBy(prio, F.desc(locator))
    most = max([default, *caps.values()])
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).where(F.col("_k") <= cap).drop("_k")


def quota_sample(df: DataFrame, key: str, quotas: dict[str, int], seed: int, locator: str, exclude: DataFrame | None = None, reserve: float = 1.1, strict: bool = True) -> DataFrame:
    """quotas[key] rows by priority, after a larger first draw that loses excluded and repeated contents; fails where too few are left, if strict."""
    drawn = capped_sample(df, key, {k: max(q, round(q * reserve)) for k, q in quotas.items()}, seed, locator)
    fresh = exclude_hashes(drawn, exclude) if exclude is not None else drawn
    first = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("content_sha256").orderBy(locator))).where("_k = 1").drop("_k")
    out = capped_sample(first, key, quotas, seed, locator)
    if strict:
        got = {r[0]: r[1] for r in out.groupBy(key).count().collect()}  # one row per quota
        short = {k: (got.get(k, 0), q) for k, q in quotas.items() if got.get(k, 0) < q}
        if short:
            raise ValueError(f"quotas not reached: {short}")
    return out


def round_robin_subset(df: DataFrame, cap: int, seed: int) -> DataFrame:
    """cap // 2 rows per class, sources in turn, alphabetically; within a source by hash. All rows if cap <= 0."""
    if cap <= 0:
        return df
    inside = Window.partitionBy("label", "source").orderBy(S.priority(str(seed), F.col("sample_id")), "sample_id")
    turns = df.withColumn("_turn", F.row_number().over(inside)).where(F.col("_turn") <= cap // 2)  # no source gives more
    return turns.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("_turn", "source"))).where(F.col("_k") <= cap // 2).drop("_turn", "_k")


def first_by_hash(df: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """The first row of each content by (role, sample_id); contents of `exclude` count as seen."""
    rows = exclude_hashes(df, exclude) if exclude is not None else df
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("content_sha256").orderBy("role", "sample_id"))).where("_k = 1").drop("_k")


def dedup_with_provenance(df: DataFrame, seq: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): the first row of each content by `seq`; every later one beside the kept row's columns."""
    w = Window.partitionBy("content_sha256").orderBy(seq)
    r = df.withColumn("_k", F.row_number().over(w)).withColumns({f"kept_{c}": F.first(c).over(w) for c in columns})
    return r.where("_k = 1").drop("_k", *[f"kept_{c}" for c in columns]), r.where("_k > 1").drop("_k")


def group_folds(df: DataFrame, folds: int, seed: int) -> DataFrame:
    """df with (fold, grouped): groups in hash order within each class, dealt in turn. With less than two groups in a class,
    rows are dealt by the hash of their content, and grouped is false."""
    g = df.select("label", "group_id").distinct()
    order = Window.partitionBy("label").orderBy(S.priority(str(seed), F.col("group_id")), "group_id")
    k = g.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.min("n"), F.lit(folds)).alias("k"), F.count(F.lit(1)).alias("classes"))
    k = k.withColumn("k", F.when(F.col("classes") == 2, F.col("k")).otherwise(0)).drop("classes")
    dealt = g.withColumn("_i", F.row_number().over(order) - 1).crossJoin(k)  # one row
    by_content = (S.hash_number(str(seed), F.col("content_sha256")) % folds).cast("int")
    return df.join(dealt, ["label", "group_id"]).withColumn("grouped", F.col("k") >= 2).withColumn("fold", F.when(F.col("grouped"), F.col("_i") % F.greatest("k", F.lit(1))).otherwise(by_content)).drop("_i", "k")


def logo_folds(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """df with fold: each positive group is one, in order of name; negatives are dealt over as many by hash. Within each key of `by`, if given."""
    by = list(by)
    g = df.where("label = 1").select(*by, "group_id").distinct()
    g = numbered(in_parts(g, [*by, "group_id"], "groups"), by, ["group_id"], "_f")
    n = g.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(df.join(g, [*by, "group_id"], "left"), n, by)
    return rows.withColumn("fold", F.when(F.col("label") == 1, F.col("_f")).otherwise(S.hash_number(F.col("sample_id")) % F.greatest("_n", F.lit(1))).cast("int")).drop("_f", "_n")


def rank_candidates(scores: DataFrame) -> DataFrame:
    """scores (model, macro_score, auc, eligible) with rank, eligible ones first; fails where none is eligible."""
    some = F.max(F.col("eligible").cast("int")).over(Window.partitionBy())  # a row per model
    ok = F.when(some == 1, F.col("eligible")).otherwise(F.raise_error(F.lit("no eligible candidate")).cast("boolean"))
    return scores.withColumn("eligible", ok).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("eligible"), F.desc("macro_score"), F.desc("auc"), "model")))


def pick_calibrator(scores: DataFrame) -> DataFrame:
    """The row of best macro score, then lowest log loss, then simplest method."""
    simple = F.when(F.col("method") == "identity", 0).when(F.col("method") == "bias", 1).otherwise(2)
    return scores.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("macro_score"), "log_loss", simple))).where("_k = 1").drop("_k")


def examples(df: DataFrame, keys: list[str], n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, total, examples): how many offenders there are in truth, and the keys of the first n; of each group of `by`, if given. No row if there are none."""
    rows = df.withColumn("_all", F.lit(0))
    return first_k(rows, [*by, "_all"], keys, n, F.struct(*keys), "total", "examples").drop("_all")


def misses(df: DataFrame, view: str, threshold: float) -> DataFrame:
    """Positives below the threshold, lowest first."""
    return df.where((F.col("view") == view) & (F.col("label") == 1) & (F.col("probability") < threshold)).orderBy("probability", "sample_id")


def canary_summary(health: DataFrame) -> DataFrame:
    """One row from curve_health() with (steps, samples, eligible) of the runs: of healthy runs, the one of lowest last loss, then slope, then gradient; the one of best last validation, then best
    validation; the same among eligible ones (recommended); whether all runs had equal steps and samples. Of equal runs the smallest run_id."""
    ok, few = F.col("healthy"), F.col("healthy") & F.col("eligible")
    score = F.struct(-F.col("last_score"), -F.col("best_score"), "run_id")
    return health.agg(
        F.min_by("run_id", F.when(ok, F.struct("last_loss", "slope_100", "gradient_p95", "run_id"))).alias("healthiest"), F.min_by("run_id", F.when(ok, score)).alias("best_validation"),
        F.min_by("run_id", F.when(few, score)).alias("recommended"), F.count_if(ok).alias("healthy_runs"), (F.count_distinct("steps") == 1).alias("equal_steps"), (F.count_distinct("samples") == 1).alias("equal_samples"),
    )
