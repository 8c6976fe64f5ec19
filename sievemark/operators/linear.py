"""Linear probes with Spark ML, and batch scoring to a ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import written
from . import metrics as M
from .sampling import group_folds, logo_folds


def _class_weights(df: DataFrame) -> DataFrame:
    """df with weight: both classes weigh the same."""
    n = df.agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    w = F.when(F.col("label") == 1, (F.col("_p") + F.col("_n")) / (2 * F.col("_p"))).otherwise((F.col("_p") + F.col("_n")) / (2 * F.col("_n")))
    return df.crossJoin(n).withColumn("weight", w).drop("_p", "_n")  # one row


def leakage_probe(df: DataFrame, features: list[str], folds: int, seed: int, most: float = 0.6) -> DataFrame:
    """One row: how well metadata alone tells the classes apart, out of fold, and whether that passes (AUC <= most, folds by group).

    Features are standardised on each fold's training rows (deviations under 1e-8 count as 1); the sum of the weighted losses has a ridge of 0.0005 for each squared coefficient.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(group_folds(df, folds, seed).select("label", "fold", "grouped", *features).repartition(tasks), "probe-rows")  # each fit reads it many times; short rows would lie in few files
    scored = None
    for k in sorted(r[0] for r in rows.select("fold").distinct().collect()):  # a few folds
        train = rows.where(F.col("fold") != k)
        stats = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
        scale = lambda d: d.withColumn("x", array_to_vector(F.array(*[(F.col(f) - stats[f"m_{f}"]) / (stats[f"s_{f}"] if stats[f"s_{f}"] > 1e-8 else 1.0) for f in features])))
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-3 / max(1, stats["n"]), standardization=False, maxIter=100).fit(scale(_class_weights(train)))
        part = model.transform(scale(rows.where(F.col("fold") == k))).select("label", "grouped", vector_to_array("probability")[1].alias("probability"))
        scored = part if scored is None else scored.unionByName(part)
    out = M.roc_auc(scored.withColumn("_", F.lit(1)), ["_"]).drop("_").crossJoin(M.rates(M.confusion(scored, [], 0.5)).select("n", "balanced_accuracy")).crossJoin(scored.agg(F.bool_and("grouped").alias("grouped")))  # one row each
    return out.withColumn("passed", (F.col("auc") <= most) & F.col("grouped"))


def linear_probe(df: DataFrame, features: str, ridge: float = 1e-3) -> DataFrame:
    """(sample_id, view, label, raw_logit, probe_fit): calibration rows are scored by fits that left out their positive group, or their share of the negatives (`out_of_fold`), test rows by a fit on all
    calibration rows (`all_calibration`). Features are scaled to length 1; the loss is the mean over rows, classes weighed equally, with ridge / 2 for each squared coefficient. A fold is a model and
    a job; needs three positive groups."""
    rows = df.withColumn("x", array_to_vector(S.l2_normalize(F.col(features))))
    cal = logo_folds(rows.where("role = 'calibration'")).persist()  # each fit reads it many times
    folds = [r[0] for r in cal.where("label = 1").select("fold").distinct().orderBy("fold").collect()]  # a row per positive group
    if len(folds) < 3:
        raise ValueError(f"three positive groups are needed, there are {len(folds)}")
    fit = lambda d: LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=ridge, standardization=False, maxIter=200, tol=1e-9).fit(_class_weights(d))
    score = lambda m, d, name: m.transform(d).select("sample_id", "view", "label", vector_to_array("rawPrediction")[1].alias("raw_logit"), F.lit(name).alias("probe_fit"))
    out = score(fit(cal), rows.where("role = 'test'"), "all_calibration")
    for k in folds:
        out = out.unionByName(score(fit(cal.where(F.col("fold") != k)), cal.where(F.col("fold") == k), "out_of_fold"))
    return out


def feature_coverage(manifest: DataFrame, views: list[str], features: DataFrame) -> DataFrame:
    """Keys of the manifest without a feature vector."""
    from .joins import expected_keys

    return expected_keys(manifest.select("sample_id"), views).join(features.where("features is not null").select("sample_id", "view"), ["sample_id", "view"], "left_anti")


def score_to_ledger(df: DataFrame, fn: Callable[[pd.Series], pd.Series], column: str, model_id: str) -> DataFrame:
    """(sample_id, view, raw_logit, error, model_id): fn maps a batch of the column to logits. A batch that fails is scored row by row, and a row that fails keeps its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["sample_id", "view"]].assign(raw_logit=None, error=None, model_id=model_id)
            try:
                out["raw_logit"] = fn(b[column]).astype(float).to_numpy()
            except Exception:  # noqa: BLE001  a user's function; the row says what happened
                for i in range(len(b)):
                    try:
                        out.iloc[i, 2] = float(fn(b[column].iloc[i : i + 1]).iloc[0])
                    except Exception as e:  # noqa: BLE001
                        out.iloc[i, 3] = f"{type(e).__name__}: {e}"[:500]
            yield out

    return df.select("sample_id", "view", column).mapInPandas(run, "sample_id string, view string, raw_logit double, error string, model_id string")
