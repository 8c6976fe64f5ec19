"""Manifest audits, decontamination and corpus assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import joins as J
from . import sampling as W
from . import sets as U
from .ordered import first_k
from .slices import composition

ERRORS = ("duplicate_sample_id", "group_crosses_roles", "exact_overlap", "near_overlap", "bad_content_hash", "bad_phash", "missing_file")


def overlap_issues(manifest: DataFrame, listed: int = 20, order: str | None = None) -> DataFrame:
    """(code, key, n, roles, members): ids of more than one row, groups and contents in more than one role. n rows have the key; roles are all of theirs, sorted; members are the first
    `listed` sample ids by `order` (default: by id). A key that holds a third of the rows leaves each task as `listed` of them."""
    def issues(code: str, key: str, found) -> DataFrame:
        keys = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("role")).alias("roles")).where(found)  # a few roles
        rows = manifest.join(keys.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")
        lists = first_k(rows, [key], [order or "sample_id", "sample_id", "role"], listed, F.col("sample_id"), "_n", "members").drop("_n")
        return keys.join(lists, key).select(F.lit(code).alias("code"), F.col(key).alias("key"), "n", F.array_join("roles", ",").alias("roles"), F.array_join("members", ",").alias("members"))

    crossed = F.size("roles") > 1
    return issues("duplicate_sample_id", "sample_id", F.col("n") > 1).unionByName(issues("group_crosses_roles", "group_id", crossed)).unionByName(issues("exact_overlap", "content_sha256", crossed))


def hash_issues(manifest: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(code, n): malformed content hashes, malformed 64-bit hashes, and paths that the listing lacks."""
    counts = manifest.agg(F.count_if(~S.is_hex(F.col("content_sha256"), 64)).alias("bad_content_hash"), F.count_if(~S.is_hex(F.col("phash"), 16)).alias("bad_phash"))
    if listing is not None:
        counts = counts.crossJoin(manifest.join(listing.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("missing_file")))  # one row each
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in counts.columns])).alias("x")).select("x.*")


def audit_manifest(manifest: DataFrame, distance: int = 4, listing: DataFrame | None = None) -> DataFrame:
    """(code, n, severity): how many issues of each kind; a manifest is valid if none is an error with n > 0."""
    parts = overlap_issues(manifest).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    near = J.near_pairs(manifest, distance).agg(F.count(F.lit(1)).alias("n")).select(F.lit("near_overlap").alias("code"), "n")
    found = parts.unionByName(near).unionByName(hash_issues(manifest, listing))
    names = manifest.sparkSession.createDataFrame([(c,) for c in ERRORS], "code string")
    out = names.join(found, "code", "left").na.fill(0, ["n"])
    return out.withColumn("severity", F.when(F.col("n") == 0, "ok").when(F.col("code") == "missing_file", "warning").otherwise("error"))


def drop_cross_role_near(manifest: DataFrame, distance: int, drop_role: str = "calibration") -> DataFrame:
    """manifest without the rows of drop_role that have a near row in another role. One pass: neighbours are of other roles, so none is dropped itself.

    A pair without a row of drop_role fails."""
    pairs = J.near_pairs(manifest, distance)
    roles = manifest.groupBy("sample_id").agg(F.first("role").alias("role"))
    # near_pairs() names the smallest id of equal (hash, role, content); all of them go.
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.*")
    both = ends.join(roles.select(F.col("sample_id").alias("x"), F.col("role").alias("rx")), "x").join(roles.select(F.col("sample_id").alias("y"), F.col("role").alias("ry")), "y")
    ok = F.when((F.col("rx") == drop_role) | (F.col("ry") == drop_role), F.col("x")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no row to drop:"), "x", "y")).cast("string"))
    out = both.withColumn("x", ok).where(F.col("rx") == drop_role).select(F.col("x").alias("sample_id")).distinct()
    gone = manifest.join(out, "sample_id", "left_semi").select("phash", "role", "content_sha256").distinct()
    return manifest.join(gone, ["phash", "role", "content_sha256"], "left_anti")


def assemble_training(parts: list[DataFrame], exclude: DataFrame, distance: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the union without excluded and repeated contents, and near rows of other roles; counts by role, label and source."""
    rows = W.first_by_hash(U.union_manifests(*parts), exclude)
    if distance is not None:
        rows = drop_cross_role_near(rows, distance)
    return rows, composition(rows, ["role", "label", "source"])


def prepare_corpus(stage: DataFrame, protected: DataFrame, cap: int, modulus: int, seed: int, distance: int = 4) -> DataFrame:
    """(sample_id, decision) of every staged row: `holdout` by hash, else `exact` or `near` to a protected row, else `capped` or `kept`."""
    held = stage.withColumn("_h", S.hash_holdout(F.sha2("sample_id", 256), modulus))
    bad = J.decontaminate(held.where("not _h"), protected, distance)
    rest = held.where("not _h").join(bad, "sample_id", "left_anti")
    kept = W.capped_sample(rest, "label", {}, seed, "sample_id", default=cap).select("sample_id", F.lit("kept").alias("_k"))
    out = held.join(bad, "sample_id", "left").join(kept, "sample_id", "left")
    return out.select("sample_id", F.when(F.col("_h"), "holdout").otherwise(F.coalesce("reason", "_k", F.lit("capped"))).alias("decision"))


def corpus_audit(attempts: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """Per model: jobs and contents, whether they are distinct and as many as expected, whether one revision made them, and how many contents no file has."""
    a = attempts.where("error is null").join(files.select(F.col("content_sha256"), F.lit(True).alias("_file")).distinct(), "content_sha256", "left")
    per = a.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"), F.count_distinct("content_sha256").alias("contents"), F.count_distinct("revision").alias("revisions"), F.count_if(F.col("_file").isNull()).alias("without_file")
    )
    ok = (F.col("n") == F.col("expected")) & (F.col("jobs") == F.col("n")) & (F.col("contents") == F.col("n")) & (F.col("revisions") == 1) & (F.col("without_file") == 0)
    return per.join(expected, "model_id", "full_outer").withColumn("valid", F.coalesce(ok, F.lit(False)))


def normalize_corpus(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates) of parts (repo, locator, prompt, generator, content_sha256), in order of (repo, locator); prompts become group ids."""
    rows = U.union_manifests(*parts).withColumn("group_id", F.concat(F.lit("prompt:"), S.prompt_hash(F.col("prompt")))).withColumn("source", S.slug(F.col("generator")))
    rows = rows.withColumn("seq", F.concat_ws("\x00", "repo", "locator"))
    kept, later = W.dedup_with_provenance(rows, "seq", ["repo", "locator", "generator"])
    return kept.drop("seq"), later.drop("seq")
