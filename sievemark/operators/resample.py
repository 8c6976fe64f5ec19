"""Bootstrap intervals and sampling plans.

A replicate draws whole clusters (images, groups). Its draws come from a splitting tree over the clusters (`replicates`), so the input is read once however many replicates there are;
clustered_bootstrap() can also take one hash for each replicate and slot, which SQL can do as well. Either way the same seed gives the same result on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import written
from .joins import weighted_draw
from .ordered import places
from .replicates import replicate_auc, replicate_counts, replicate_sums


def numbered(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """df with (i, n): place by key within the group, and the group's size; df has a row per cluster."""
    return places(df, by, key, "i", "n")


def draw_weights(clusters: DataFrame, replicates: int, seed: int, by: str = "label") -> DataFrame:
    """(rep, label, i, weight): how often each replicate draws cluster i of n, with replacement.

    Each cluster row gives one slot for each replicate, so the draws are spread as the clusters are."""
    slots = clusters.select(by, "i", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = S.uniform(str(seed), F.col("rep"), F.col(by), F.col("i"))
    return slots.select("rep", by, F.floor(u * F.col("n")).cast("int").alias("i")).groupBy("rep", by, "i").agg(F.count(F.lit(1)).alias("weight"))


def cluster_sums(df: DataFrame, threshold: float, probability: str = "probability") -> DataFrame:
    """(label, sample_id, rows, ok, brier): all views of a sample move together."""
    p = F.col(probability)
    return df.groupBy("label", "sample_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(S.correct(F.col("label"), p, threshold).cast("long")).alias("ok"), F.sum((p - F.col("label")) ** 2).alias("brier")
    )


def intervals(stats: DataFrame, names: list[str], confidence: float) -> DataFrame:
    """(metric, low, high, mean) over the replicates."""
    a = (1 - confidence) / 2
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.percentile("x", a).alias("low"), F.percentile("x", 1 - a).alias("high"), F.avg("x").alias("mean"))


def _weighted(names: list[str]):
    """Kernel: sums of the clusters' columns, each as often as the cluster is drawn."""
    return lambda table, counts, rng: {n: counts @ table.column(n).to_numpy().astype(float) for n in names}


def _rates(sums: DataFrame, prefix: str = "", ok: str = "ok", brier: str = "brier") -> DataFrame:
    """(rep, recall, specificity, brier, balanced_accuracy) from sums by label and replicate, the names prefixed."""
    of = lambda l, c: F.sum(F.when(F.col("label") == l, F.col(c)))
    rate = lambda l: F.try_divide(of(l, ok), of(l, "rows"))
    stats = sums.groupBy("rep").agg(rate(1).alias(f"{prefix}recall"), rate(0).alias(f"{prefix}specificity"), (F.sum(brier) / F.sum("rows")).alias(f"{prefix}brier"))
    return stats.withColumn(f"{prefix}balanced_accuracy", (F.col(f"{prefix}recall") + F.col(f"{prefix}specificity")) / 2)


def clustered_bootstrap(df: DataFrame, replicates: int, seed: int, threshold: float, confidence: float = 0.95, draws: str = "tree") -> DataFrame:
    """Intervals of balanced accuracy, recall, specificity and Brier score; samples are drawn within each class. draws: `tree`, or `slots`: a hash for each replicate and slot,
    which are as many rows as clusters times replicates."""
    c = cluster_sums(df, threshold)
    names = ["rows", "ok", "brier"]
    if draws == "slots":
        c = numbered(c, ["label"], "sample_id")
        w = draw_weights(c, replicates, seed).join(c.drop("n"), ["label", "i"])
        sums = w.groupBy("rep", "label").agg(*[F.sum(F.col(n) * F.col("weight")).alias(n) for n in names])
    else:
        sums = replicate_sums(c, ["label"], "sample_id", _weighted(names), names, replicates, seed)
    return intervals(_rates(sums), ["balanced_accuracy", "recall", "specificity", "brier"], confidence)


def bootstrap_auc(df: DataFrame, replicates: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Interval of the AUC: each replicate's draws weigh its samples' rows."""
    w = replicate_counts(df.select("label", "sample_id").distinct(), ["label"], "sample_id", replicates, seed)
    rows = df.select("label", "sample_id", "probability").join(w, ["label", "sample_id"])
    return intervals(replicate_auc(rows, [], replicates), ["auc"], confidence)


def bootstrap_report(df: DataFrame, replicates: int, seed: int, threshold: float, confidence: float = 0.95) -> DataFrame:
    """Intervals of balanced accuracy, recall, specificity, Brier score and AUC, of the same draws."""
    return clustered_bootstrap(df, replicates, seed, threshold, confidence).unionByName(bootstrap_auc(df, replicates, seed, confidence))


def paired_bootstrap(paired: DataFrame, replicates: int, seed: int, threshold: float, confidence: float = 0.95) -> DataFrame:
    """Intervals of right minus left; promote where the low end of balanced accuracy is over 0. Both sides share the draws."""
    ok = lambda p: S.correct(F.col("label"), F.col(p), threshold).cast("long")
    loss = lambda p: (F.col(p) - F.col("label")) ** 2
    c = paired.groupBy("label", "sample_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(ok("right") - ok("left")).alias("ok"), F.sum(loss("right") - loss("left")).alias("brier"))
    names = ["rows", "ok", "brier"]
    stats = _rates(replicate_sums(c, ["label"], "sample_id", _weighted(names), names, replicates, seed), "delta_")
    out = intervals(stats, ["delta_balanced_accuracy", "delta_recall", "delta_specificity", "delta_brier"], confidence)
    return out.withColumn("promote", (F.col("metric") == "delta_balanced_accuracy") & (F.col("low") > 0))


def _drawn_rates(table, counts, rng):
    """Kernel: the sum of the drawn groups' rates, each draw of a group with draws of its rows. The right ones among w draws of a group of n rows are one binomial draw of w n rows."""
    rows, ok = (table.column(c).to_numpy() for c in ("rows", "ok"))
    return {"rate": (rng.binomial(counts * rows, ok / rows) / rows).sum(axis=1), "groups": counts.sum(axis=1)}


def hierarchical_bootstrap(df: DataFrame, replicates: int, seed: int, threshold: float, confidence: float = 0.95) -> DataFrame:
    """Groups are drawn within each class, then rows within each drawn group. Of a group only its size and how many are right count."""
    g = df.groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(S.correct(F.col("label"), F.col("probability"), threshold).cast("long")).alias("ok"))
    per = replicate_sums(g, ["label"], "group_id", _drawn_rates, ["rate", "groups"], replicates, seed).withColumn("r", F.col("rate") / F.col("groups"))
    stats = per.groupBy("rep").agg(F.max(F.when(F.col("label") == 1, F.col("r"))).alias("macro_recall"), F.max(F.when(F.col("label") == 0, F.col("r"))).alias("macro_specificity"))
    stats = stats.withColumn("macro_balanced_accuracy", (F.col("macro_recall") + F.col("macro_specificity")) / 2)
    return intervals(stats, ["macro_recall", "macro_specificity", "macro_balanced_accuracy"], confidence)


def group_auc_bootstrap(a: DataFrame, b: DataFrame, replicates: int, seed: int, confidence: float = 0.9) -> DataFrame:
    """Interval of the AUC of a less that of b, mean over views, groups drawn within each class; a replicate that drew one class only has none."""
    # Written, so that Spark knows how small the groups are: by its estimate they are larger than the rows, which it would broadcast to the one task that has the groups.
    w = written(replicate_counts(a.select("label", "group_id").distinct(), ["label"], "group_id", replicates, seed), "group-counts")
    slim = lambda df, side: df.select("label", "group_id", "view", "probability", F.lit(side).alias("side"))
    rows = slim(a, 1).unionByName(slim(b, -1)).join(w, ["label", "group_id"])
    per = replicate_auc(rows, ["side", "view"], replicates)
    stats = per.groupBy("rep", "view").agg(F.sum(F.col("auc") * F.col("side")).alias("d"), F.count("auc").alias("n")).where("n = 2").groupBy("rep").agg(F.avg("d").alias("delta_auc"))
    return intervals(stats, ["delta_auc"], confidence)


def balanced_plan(df: DataFrame, steps: range, batch: int, seed: int, exponent: float) -> DataFrame:
    """(step, label, slot, sample_id, draw_seed): each step takes half a batch of each class; a source's chance is its size to the
    power `exponent`, a row's is even within its source. A step depends on its number only, so a plan can be made in parts."""
    rows = places(df.select("label", "source", "sample_id"), ["label", "source"], "sample_id", "i")
    sources = df.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))
    spark, plans = df.sparkSession, []
    for label in (0, 1):
        s = sources.where(F.col("label") == label).select("source", (F.col("n") ** exponent).alias("weight"), "n")
        slots = spark.range(steps.start, steps.stop).select(F.col("id").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(batch // 2 - 1))).alias("slot"))
        slots = slots.withColumn("u", S.uniform(str(seed), F.col("step"), F.lit(label), F.col("slot")))
        drawn = weighted_draw(slots, s.select("source", "weight")).join(s.select("source", "n"), "source")
        place = F.floor(S.uniform(str(seed), F.lit("row"), F.col("step"), F.lit(label), F.col("slot")) * F.col("n")).cast("int")
        drawn = drawn.withColumn("i", place).withColumn("label", F.lit(label))
        plans.append(drawn.join(rows.select("label", "source", "i", "sample_id"), ["label", "source", "i"]))
    plan = plans[0].unionByName(plans[1])
    return plan.select("step", "label", "slot", "source", "sample_id", S.hash_number(str(seed), F.col("step"), F.col("slot"), F.col("sample_id")).alias("draw_seed"))


def expand_views(manifest: DataFrame, registry: DataFrame, seed: int) -> DataFrame:
    """manifest x the cases of a declared registry (tens of rows), each with a seed of its own."""
    out = manifest.crossJoin(F.broadcast(registry))
    return out.withColumn("draw_seed", S.draw_seed(seed, F.col("sample_id"), F.col("case_id")))
