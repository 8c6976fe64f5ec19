"""Queries: scans and sinks. Those that write put their files under spark.checkpoint.dir, or a temporary folder where it is unset."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..sources import manifests as R
from ..sources.tables import folder
from . import views as V
from .q_metrics import BASE, rounded
from .registry import query
from .views import with_views


@query("s1_manifest_roundtrip", with_views("SELECT sample_id, path, label, dataset, source, group_id, role, content_sha256, substr(content_sha256, 1, 16) AS phash, width::INT AS width FROM manifest", "manifest"))
def _(spark, d):
    """Written as CSV and read back."""
    m = V.manifest(spark, d).select("sample_id", F.concat(F.lit("/"), "path").alias("path"), "label", "dataset", "source", "group_id", "role", "content_sha256", F.substring("content_sha256", 1, 16).alias("phash"), "width")
    R.write_manifest(m, p := folder(spark, "manifest"))
    return R.read_manifest(spark, p)[0].withColumn("path", F.substr("path", F.lit(2)))


@query("s3_ledger_roundtrip", with_views("SELECT sample_id, view, round(raw_logit, 6) AS raw_logit, error, model_id FROM ledger", "manifest", "ledger"))
def _(spark, d):
    """S3, S4."""
    R.write_ledger(V.ledger(spark, d).drop("view_pos"), p := folder(spark, "ledger"))
    return rounded(R.read_ledger(spark, p).select("sample_id", "view", "raw_logit", "error", "model_id"))


@query("s5_report", "SELECT lang, count(*) AS n, NULL::DOUBLE AS nothing FROM documents GROUP BY lang")
def _(spark, d):
    r = V.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.first(F.lit(float("nan"))).alias("nothing"))
    R.write_report({"langs": r}, p := folder(spark, "report"))
    return spark.read.schema("lang string, n long, nothing double").json(f"{p}/langs")


@query("s6_scored_roundtrip", with_views("SELECT sample_id, view, label, round(probability, 6) AS probability FROM scored", *BASE))
def _(spark, d):
    """S6, S7."""
    R.write_scored(V.scored(spark, d), p := folder(spark, "scored"), V.THRESHOLD, "csv")
    return rounded(R.read_scored(spark, p).select("sample_id", "view", "label", "probability"))


@query("s8_registry", "SELECT sample_id, case_id, family, position FROM (SELECT CAST(doc_id AS VARCHAR) AS sample_id FROM documents), (VALUES ('clean', 'none', 0), ('jpeg_q75', 'jpeg', 1)) t(case_id, family, position)")
def _(spark, d):
    cases = {"clean": {"family": "none"}, "jpeg_q75": {"family": "jpeg", "severity": "mild", "operations": [{"op": "jpeg", "quality": 75}]}, "other": {"family": "x"}}
    doc = json.dumps({"cases": cases, "profiles": {"small": ["clean", "jpeg_q75"], "whole": list(cases)}}, indent=1)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(p := folder(spark, "registry"))
    reg = R.read_registry(spark, p, "small")
    docs = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    return docs.crossJoin(F.broadcast(reg)).select("sample_id", "case_id", "family", "position")  # two cases


@query("s9_fetch_payload", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    """Candidates by label only, then their texts."""
    chosen = R.scan_candidates(V.table(spark, d, "labels"), ["doc_id", "quality"]).where("quality = 0")
    return R.fetch_payload(chosen, V.table(spark, d, "documents"), "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("s11_files", "SELECT lang AS source, quality AS label, 'docs:' || CASE quality WHEN 1 THEN 'fake' ELSE 'real' END || ':' || lang AS group_id FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(spark, d):
    """Documents as files of root/<source>/<label name>/, found again."""
    m = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("a"), F.when(F.col("quality") == 1, "ai").otherwise("real").alias("b"), F.col("text").alias("value"))
    m.write.partitionBy("a", "b").text(p := folder(spark, "files"))
    parts = lambda x: (F.substring_index(F.element_at(x, 1), "=", -1), F.substring_index(F.element_at(x, 2), "=", -1))
    return R.manifest_from_files(spark, p, "docs", "train", parts, ("txt",)).groupBy("source", "label", "group_id").agg(F.count(F.lit(1)).alias("files")).where("files > 0").drop("files")


@query("s12_inventory", with_views("SELECT sample_id, content_sha256 FROM manifest", "manifest"))
def _(spark, d):
    V.manifest(spark, d).select("sample_id", "content_sha256").write.option("header", True).option("compression", "gzip").csv(p := folder(spark, "inventory"))
    return R.read_inventory(spark, p)


@query("s13_unpivot_models", "SELECT l_orderkey, l_linenumber, 'a' AS model, 'images/' || l_partkey AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'b', 'images/' || l_suppkey FROM lineitem WHERE l_quantity > 25")
def _(spark, d):
    w = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("images/"), "l_partkey").alias("a"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("images/"), "l_suppkey")).otherwise("none").alias("b"))
    return R.unpivot_models(w, ["l_orderkey", "l_linenumber"], ["a", "b"])


@query("s14_unpivot_slots", "SELECT l_orderkey, l_linenumber, 1 AS slot, l_partkey AS image, round(l_quantity, 4) AS score FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, l_suppkey, round(l_discount, 4) FROM lineitem")
def _(spark, d):
    w = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image1"), F.round("l_quantity", 4).alias("score1"), F.col("l_suppkey").alias("image2"), F.round("l_discount", 4).alias("score2"))
    return R.unpivot_slots(w, ["l_orderkey", "l_linenumber"], ["image", "score"])


@query("s15_shard_report", "SELECT count(*) AS rows, true AS groups_bounded, true AS files_bounded, true AS as_listed FROM documents")
def _(spark, d):
    """Rows by the footers, bounds of files and row groups, and bytes and digests as Spark's own readers see the files."""
    R.write_corpus(V.table(spark, d, "documents"), p := folder(spark, "corpus"), 300, 100)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(p).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    r = R.shard_report(spark, p).join(listed, "file", "full")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha"))
    return r.agg(F.sum("rows").alias("rows"), F.bool_and(F.col("largest_group") <= 100).alias("groups_bounded"), F.bool_and(F.col("rows") <= 300).alias("files_bounded"), F.bool_and(F.coalesce(same, F.lit(False))).alias("as_listed"))


@query("s16_attempts", "SELECT event_id FROM events WHERE value >= 10")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("value") < 10, "low").alias("error"))
    R.write_ledger(e, p := folder(spark, "attempts"))
    return R.read_attempts(spark, p, "event_id long, error string").select("event_id")


@query("s17_duplicates", "SELECT content_sha256, repo, locator FROM (SELECT sha256(text) AS content_sha256, lang AS repo, doc_id AS locator, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def _(spark, d):
    from ..operators.sampling import dedup_with_provenance

    docs = V.table(spark, d, "documents").select(F.sha2("text", 256).alias("content_sha256"), F.col("lang").alias("repo"), F.col("doc_id").alias("locator"))
    R.write_duplicates(dedup_with_provenance(docs, "locator", ["repo"])[1].drop("kept_repo"), p := folder(spark, "duplicates"))
    return spark.read.schema("content_sha256 string, repo string, locator long").json(p)


@query("s18_fingerprint", "SELECT count(*) AS rows, true AS same_in_any_order, true AS other_without_a_row FROM documents")
def _(spark, d):
    """The digest holds over any order and partitioning, and changes with the rows."""
    t = V.table(spark, d, "documents")
    own, mixed, less = (R.fingerprint(x) for x in (t, t.repartition("doc_id").sortWithinPartitions("text"), t.where(F.col("doc_id") != 0)))
    names = lambda f, k: f.select(F.col("digest").alias(k))
    return own.crossJoin(names(mixed, "_m")).crossJoin(names(less, "_l")).select("rows", (F.col("digest") == F.col("_m")).alias("same_in_any_order"), (F.col("digest") != F.col("_l")).alias("other_without_a_row"))  # one row each


@query("s18_file_fingerprints", "SELECT count(DISTINCT lang) AS files, count(DISTINCT lang) AS contents, true AS as_computed FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    """A file for each language, whose bytes are known: the digests are those of the bytes."""
    t = V.table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.concat_ws(",", F.sort_array(F.collect_set(F.col("doc_id").cast("string")))).alias("value"))
    t.repartition("lang").write.partitionBy("lang").text(p := folder(spark, "files"))
    got = R.file_fingerprints(spark, p, "*.txt")
    return got.join(t.select(F.sha2(F.concat("value", F.lit("\n")), 256).alias("sha256"), F.lit(True).alias("known")), "sha256", "left").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("sha256").alias("contents"), F.bool_and(F.coalesce("known", F.lit(False))).alias("as_computed"))
