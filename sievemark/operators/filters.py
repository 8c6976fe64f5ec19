"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_role(df: DataFrame, roles: list[str]) -> DataFrame:
    return df.where(F.col("role").isin(roles))


def valid_predictions(df: DataFrame) -> DataFrame:
    return df.where("error is null and raw_logit is not null")


def view_class(view: Column) -> Column:
    """`clean`, `critical` (small resizes and low quality) or `other`."""
    return F.when(view == "clean", "clean").when(view.rlike("^resize_(96|64|48|32)$") | view.startswith("lowq_"), "critical").otherwise("other")


def having_support(df: DataFrame, by: list[str], minimum: int) -> DataFrame:
    """Groups of at least `minimum` rows and both classes."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes")).where((F.col("n") >= minimum) & (F.col("classes") == 2))


def assert_positive_cohort(df: DataFrame) -> None:
    """Fails unless all rows are positive test rows with distinct ids."""
    bad = df.agg(F.count_if(F.col("label") != 1).alias("negative"), F.count_if(F.col("role") != "test").alias("other_role"), (F.count(F.lit(1)) - F.count_distinct("sample_id")).alias("repeated"), F.count(F.lit(1)).alias("rows")).first()
    if any(bad[c] for c in ("negative", "other_role", "repeated")) or not bad["rows"]:
        raise ValueError(f"not a positive test cohort: {bad.asDict()}")


def protected_rows(df: DataFrame, whole: bool) -> DataFrame:
    """Distinct (content_sha256, phash) of the whole cohort, or of rows outside training."""
    return (df if whole else df.where("role <> 'train'")).dropDuplicates(["content_sha256", "phash"])


def head_per_class(df: DataFrame, n: int, order: str = "line") -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(order))).where(F.col("_k") <= n).drop("_k")


def successes(df: DataFrame) -> DataFrame:
    return df.where("error is null or error = ''")
