"""Set operations over manifests, keys and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_manifests(*dfs: DataFrame) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    x, y = a.select(*keys), b.select(*keys)
    return x.subtract(y), y.subtract(x)


def common_views(a: DataFrame, b: DataFrame, base: str = "clean") -> DataFrame:
    return a.select("view").intersect(b.select("view")).where(F.col("view") != base)


def missing_families(observed: DataFrame, required: list[str]) -> DataFrame:
    need = observed.sparkSession.createDataFrame([(f,) for f in required], "family string")
    return need.join(observed.select("family").distinct(), "family", "left_anti")


def relabel_role(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.where(F.col("role") == old).withColumn("role", F.lit(new))
