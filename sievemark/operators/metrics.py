"""Binary-classification metrics as grouped aggregates over (label, probability).

`by` lists the group columns; all functions return one row per group. Undefined rates are null, never NaN. Rank metrics go
over distinct scores in parts of their order (`ordered`), so that no task sorts a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordered import attach, in_parts, running

COUNTS = ("tp", "tn", "fp", "fn")


def confusion_columns(threshold: float, label: str = "label", p: str = "probability") -> list[Column]:
    hit, pos = F.col(p) >= threshold, F.col(label) == 1
    return [
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"),
        F.count(F.lit(1)).alias("n"), F.count_if(~pos).alias("n_real"), F.count_if(pos).alias("n_fake"),
    ]


def rate_columns() -> dict[str, Column]:
    """Rates and Matthews correlation from tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in COUNTS)
    tpr, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return {
        "recall": tpr,
        "specificity": tnr,
        "precision": F.try_divide(tp, tp + fp),
        "npv": F.try_divide(tn, tn + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (tpr + tnr) / 2,
        "mcc": F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def confusion(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_columns(threshold))


def rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rate_columns())


def _by_score(df: DataFrame, by: list[str], score: str, weight: Column) -> DataFrame:
    pos = F.col("label") == 1
    return df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(pos, weight).otherwise(0.0)).alias("_pos"), F.sum(F.when(pos, 0.0).otherwise(weight)).alias("_neg"))


def _by_order(df: DataFrame, by: list[str], score: str, weight: Column) -> DataFrame:
    """A row per score with its sums and those of all lower scores (_low_pos, _low_neg)."""
    parts = in_parts(_by_score(df, by, score, weight), [*by, "_s"], "scores")
    return running(parts, by, ["_s"], {"_low_pos": F.col("_pos"), "_low_neg": F.col("_neg")})


def roc_auc(df: DataFrame, by: list[str], score: str = "probability", weight: str | None = None) -> DataFrame:
    """(*by, auc): ties count half; null unless both classes are there."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    area = F.sum(F.col("_pos") * (F.col("_low_neg") + F.col("_neg") / 2))
    return _by_order(df, by, score, w).groupBy(*by).agg(F.try_divide(area, F.sum("_pos") * F.sum("_neg")).alias("auc"))


def average_precision(df: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """(*by, average_precision): scores descending, ties in the order of `tie`."""
    order = [F.desc("probability"), *tie]
    parts = in_parts(df.select(*by, "label", "probability", *tie), [*by, *order], "precision")
    r = running(parts, by, order, {"_hits": F.col("label"), "_rank": F.lit(1)})
    gain = F.when(F.col("label") == 1, (F.col("_hits") + 1) / (F.col("_rank") + 1)).otherwise(0.0)
    return r.groupBy(*by).agg(F.try_divide(F.sum(gain), F.sum("label")).alias("average_precision"))


def ece(df: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """(*by, ece): equal bins over [0, 1], the last one closed."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1))
    per = df.groupBy(*by, b.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg("probability").alias("_p"), F.avg("label").alias("_l"))
    return per.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_l"))) / F.sum("_n")).alias("ece"))


def proper_scores(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg((F.col("probability") - F.col("label")) ** 2).alias("brier"), F.avg(S.log_loss_row(F.col("label"), F.col("probability"))).alias("log_loss")
    )


def optimal_threshold(df: DataFrame, by: list[str], score: str = "raw_logit") -> DataFrame:
    """(*by, threshold, balanced): the score, used as threshold, of best balanced accuracy; ties go to the smallest (abs, value).

    Thresholds below all scores and above them reach 0.5, as does the lowest score itself, so only a best of 0.5 could meet them:
    the value just below the lowest and just above the highest score compete as those scores do.
    """
    rows = _by_order(df, by, score, F.lit(1.0))
    # True positives are all positives but the lower ones, true negatives the lower negatives; what is the same for all scores of a group is added at the end.
    all_pos, all_neg = F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    whole = _by_score(df, by, score, F.lit(1.0)).groupBy(*by).agg(all_pos, all_neg)
    goal = F.col("_low_neg") * F.col("_p") + (F.col("_p") - F.col("_low_pos")) * F.col("_n")
    best = F.min(F.struct((-goal).alias("g"), F.abs("_s").alias("a"), F.col("_s").alias("t"))).alias("_b")
    out = attach(rows, whole, by).groupBy(*by).agg(best, F.max("_p").alias("_p"), F.max("_n").alias("_n"))
    return out.select(*by, F.col("_b.t").alias("threshold"), F.try_divide(-F.col("_b.g"), 2 * F.col("_p") * F.col("_n")).alias("balanced"))


def unique_images(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct("sample_id").alias("unique_images"))


def binary_metrics(df: DataFrame, by: list[str], threshold: float, tie: tuple[str, ...] = ("line", "view_pos")) -> DataFrame:
    """All metrics of each group; the parts are joined by group, of which there are few."""
    out = rates(confusion(df, by, threshold))
    for part in (roc_auc(df, by), average_precision(df, by, list(tie)), ece(df, by), proper_scores(df, by), unique_images(df, by)):
        out = out.join(part, by) if by else out.crossJoin(part)  # one row each
    return out


def view_metrics(df: DataFrame, threshold: float) -> DataFrame:
    return rates(confusion(df, ["view"], threshold)).select("view", "n", "balanced_accuracy", "recall", "specificity").join(roc_auc(df, ["view"]), "view")
