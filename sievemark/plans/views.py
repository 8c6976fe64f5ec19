"""Manifest, ledgers and other inputs, derived from the given tables; each with the same view in SQL.

Queries read whole tables through these; nothing is cached or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

VIEWS = (("clean", 1.0), ("web", 0.6), ("hard", 0.2))
THRESHOLD = 0.65
ROLES = ("train", "calibration", "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    group = F.concat_ws(":", F.col("quality").cast("string"), "source")
    role = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("bigint") % 3
    return d.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.concat(F.lit("data/"), "doc_id", F.lit(".txt")).alias("path"),
        F.col("quality").alias("label"),
        F.col("lang").alias("dataset"),
        "source",
        group.alias("group_id"),
        F.element_at(F.array(*map(F.lit, ROLES)), (role + 1).cast("int")).alias("role"),
        F.sha2("text", 256).alias("content_sha256"),
        F.col("n_chars").alias("width"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("height"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.col("doc_id").alias("line"),
    )


def ledger(spark: SparkSession, sf_dir: str, model: str = "a", share: float = 1.0) -> DataFrame:
    """One row per (sample_id, view), a fiftieth of them errors; `share` weakens the signal of the second model."""
    views = spark.createDataFrame([(v, i, k * share) for i, (v, k) in enumerate(VIEWS)], "view string, view_pos int, k double")
    rows = manifest(spark, sf_dir).select("sample_id", "label").crossJoin(F.broadcast(views))  # three views
    u, e = S.uniform(F.col("sample_id"), F.col("view"), model), S.uniform(F.col("sample_id"), F.col("view"), "error", model)
    x = (2 * F.col("label") - 1) * F.col("k") + 4 * (u - 0.5)
    return rows.select(
        "sample_id", "view", "view_pos",
        F.when(e >= 0.02, x).alias("raw_logit"),
        F.when(e < 0.02, "timeout").alias("error"),
        F.lit(f"model-{model}").alias("model_id"),
    )


def scored(spark: SparkSession, sf_dir: str, model: str = "a", share: float = 1.0) -> DataFrame:
    """Valid predictions with their manifest columns, probability = sigmoid(raw_logit + 0.6)."""
    l = ledger(spark, sf_dir, model, share).where("error is null and raw_logit is not null")
    return l.join(manifest(spark, sf_dir), "sample_id").withColumn("probability", S.calibrate(F.col("raw_logit"), 1.0, 0.6))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a manifest with 64-bit hashes; every tenth comes again in another role, three bits turned."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), S.median_bits(F.col("embedding")).alias("phash"))
    own = e.select("id", "label", "phash", F.element_at(F.array(*map(F.lit, ROLES)), (F.col("id") % 3 + 1).cast("int")).alias("role"))
    # The last hex digit's three low bits are turned: x -> x ^ 7.
    last = F.lower(F.hex(F.conv(F.substring("phash", 16, 1), 16, 10).cast("bigint").bitwiseXOR(F.lit(7))))
    planted = e.where("id % 10 = 0").select(
        (F.col("id") + 1_000_000_000).alias("id"), "label", F.concat(F.substring("phash", 1, 15), last).alias("phash"),
        F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("id") + 1) % 3 + 1).cast("int")).alias("role"),
    )
    return own.unionByName(planted).withColumn("sample_id", F.col("id").cast("string")).withColumn("content_sha256", F.sha2("sample_id", 256))


SQL = {
    "manifest": """manifest AS (
        SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, 'data/' || d.doc_id || '.txt' AS path, l.quality AS label, d.lang AS dataset, d.source AS source,
               l.quality || ':' || d.source AS group_id,
               ['train', 'calibration', 'test'][1 + ('0x' || substr(sha256(l.quality || ':' || d.source), 1, 8))::BIGINT % 3] AS role,
               sha256(d.text) AS content_sha256, d.n_chars AS width, length(d.text) - length(replace(d.text, ' ', '')) + 1 AS height,
               CAST(strlen(d.text) AS BIGINT) AS n_bytes, d.doc_id AS line
        FROM documents d JOIN labels l USING (doc_id))""",
    "ledger": """ledger AS (
        SELECT sample_id, view, view_pos, CASE WHEN e >= 0.02 THEN (2 * label - 1) * k + 4 * (u - 0.5) END AS raw_logit,
               CASE WHEN e < 0.02 THEN 'timeout' END AS error, 'model-a' AS model_id
        FROM (SELECT m.sample_id, m.label, v.view, v.view_pos, v.k,
                     ('0x' || substr(sha256(sample_id || chr(0) || view || chr(0) || 'a'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
                     ('0x' || substr(sha256(sample_id || chr(0) || view || chr(0) || 'error' || chr(0) || 'a'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS e
              FROM manifest m, (VALUES ('clean', 0, 1.0::DOUBLE), ('web', 1, 0.6::DOUBLE), ('hard', 2, 0.2::DOUBLE)) v(view, view_pos, k)))""",
    "scored": """scored AS (
        SELECT l.sample_id, l.view, l.view_pos, l.raw_logit, m.* EXCLUDE (sample_id), 1 / (1 + exp(-(l.raw_logit + 0.6))) AS probability
        FROM ledger l JOIN manifest m USING (sample_id) WHERE error IS NULL AND raw_logit IS NOT NULL)""",
    "fingerprints": """bits AS (
        SELECT vec_id AS id, label % 2 AS label, list_sort(embedding[2:64])[32] AS mid, embedding FROM embeddings
    ), hashes AS (
        SELECT id, label, list_aggregate(list_transform(range(1, 17), lambda h: substr('0123456789abcdef', 1 + 8 * (embedding[4 * h - 3] >= mid)::INT
            + 4 * (embedding[4 * h - 2] >= mid)::INT + 2 * (embedding[4 * h - 1] >= mid)::INT + (embedding[4 * h] >= mid)::INT, 1)), 'string_agg', '') AS phash FROM bits
    ), fingerprints AS (
        SELECT *, CAST(id AS VARCHAR) AS sample_id, sha256(CAST(id AS VARCHAR)) AS content_sha256 FROM (
            SELECT id, label, phash, ['train', 'calibration', 'test'][1 + id % 3] AS role FROM hashes
            UNION ALL SELECT id + 1000000000, label, substr(phash, 1, 15) || substr('76543210fedcba98', ('0x' || substr(phash, 16, 1))::INT + 1, 1), ['train', 'calibration', 'test'][1 + (id + 1) % 3]
            FROM hashes WHERE id % 10 = 0))""",
}
SQL["ledger_b"] = SQL["ledger"].replace("ledger AS", "ledger_b AS", 1).replace("'a'", "'b'").replace("'model-a'", "'model-b'").replace("* k +", "* k * 0.8::DOUBLE +")
SQL["scored_b"] = SQL["scored"].replace("scored AS", "scored_b AS", 1).replace("FROM ledger l", "FROM ledger_b l")


def with_views(query: str, *names: str) -> str:
    """The query after the SQL of the views it reads, in the order given."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + query
