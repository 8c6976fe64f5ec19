"""Queries: filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as P
from ..operators import joins as J
from ..operators import sets as U
from ..operators.hash_index import HashIndex
from ..sources.tables import folder, written
from . import views as V
from .q_metrics import BASE, BOTH, rounded
from .registry import query
from .views import with_views

ML = ("manifest", "ledger")
VIEWS = [v for v, _ in V.VIEWS]


@query("f1_by_role", with_views("SELECT sample_id, role FROM manifest WHERE role IN ('calibration', 'test')", "manifest"))
def _(spark, d):
    return P.by_role(V.manifest(spark, d), ["calibration", "test"]).select("sample_id", "role")


@query("f2_valid_predictions", with_views("SELECT sample_id, view, round(raw_logit, 6) AS raw_logit FROM ledger WHERE error IS NULL AND raw_logit IS NOT NULL", *ML))
def _(spark, d):
    """F2, F8."""
    return rounded(P.successes(P.valid_predictions(V.ledger(spark, d))).select("sample_id", "view", "raw_logit"))


@query("f3_view_class", "SELECT CASE WHEN v = 'clean' THEN 'clean' WHEN regexp_matches(v, '^resize_(96|64|48|32)$') OR v LIKE 'lowq\\_%' ESCAPE '\\' THEN 'critical' ELSE 'other' END AS class, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'clean' WHEN 'view' THEN 'resize_64' WHEN 'purchase' THEN 'lowq_1' ELSE event_type END AS v FROM events) GROUP BY ALL")
def _(spark, d):
    e = F.col("event_type")
    v = F.when(e == "click", "clean").when(e == "view", "resize_64").when(e == "purchase", "lowq_1").otherwise(e)
    return V.table(spark, d, "events").groupBy(P.view_class(v).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_having_support", with_views("SELECT source, count(*) AS n, count(DISTINCT label) AS classes FROM manifest GROUP BY source HAVING count(*) >= 5 AND count(DISTINCT label) = 2", "manifest"))
def _(spark, d):
    return P.having_support(V.manifest(spark, d), ["source"], 5)


@query("f6_protected_rows", with_views("SELECT DISTINCT content_sha256, phash FROM fingerprints WHERE role <> 'train'", "fingerprints"))
def _(spark, d):
    return P.protected_rows(V.fingerprints(spark, d), False).select("content_sha256", "phash")


@query("f7_head_per_class", with_views("SELECT sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY line) AS k FROM manifest) WHERE k <= 25", "manifest"))
def _(spark, d):
    """the first of each class are the feature."""
    return P.head_per_class(V.manifest(spark, d), 25).select("sample_id", "label")


@query("j1_coverage", with_views("""SELECT m.sample_id, v.view, round(l.raw_logit, 6) AS raw_logit FROM manifest m CROSS JOIN (VALUES ('clean'), ('web'), ('hard')) v(view)
    JOIN ledger l ON l.sample_id = m.sample_id AND l.view = v.view AND l.raw_logit IS NOT NULL WHERE m.role = 'test'""", *ML))
def _(spark, d):
    return rounded(J.coverage_join(V.manifest(spark, d), V.ledger(spark, d), "test", VIEWS)[0].select("sample_id", "view", "raw_logit"))


@query("j1_missing", with_views("SELECT sample_id, view FROM ledger JOIN manifest USING (sample_id) WHERE role = 'test' AND raw_logit IS NULL", *ML))
def _(spark, d):
    return J.coverage_join(V.manifest(spark, d), V.ledger(spark, d), "test", VIEWS)[1]


@query("j2_protocol", with_views("""SELECT m.sample_id, r.case_id AS view, CASE WHEN l.sample_id IS NULL THEN 'missing' WHEN view_pos IS DISTINCT FROM rp THEN 'view_pos' ELSE 'model_id' END AS problem
    FROM manifest m CROSS JOIN (VALUES ('clean', 0, 'model-a'), ('web', 2, 'model-a'), ('hard', 2, 'model-b'), ('tiny', 3, 'model-a')) r(case_id, rp, rm)
    LEFT JOIN ledger l ON l.sample_id = m.sample_id AND l.view = r.case_id WHERE l.sample_id IS NULL OR view_pos IS DISTINCT FROM rp OR model_id IS DISTINCT FROM rm""", *ML))
def _(spark, d):
    reg = spark.createDataFrame([("clean", 0, "model-a"), ("web", 2, "model-a"), ("hard", 2, "model-b"), ("tiny", 3, "model-a")], "case_id string, view_pos int, model_id string")
    return J.protocol_join(V.manifest(spark, d), V.ledger(spark, d), reg, ["view_pos", "model_id"])


@query("j3_key_differences", with_views("""SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.view, b.view) AS view, CASE WHEN b.sample_id IS NULL THEN 'left' ELSE 'right' END AS side
    FROM scored a FULL JOIN scored_b b ON a.sample_id = b.sample_id AND a.view = b.view WHERE a.sample_id IS NULL OR b.sample_id IS NULL""", *BOTH))
def _(spark, d):
    return J.key_differences(V.scored(spark, d), V.scored(spark, d, "b", 0.8), ["sample_id", "view"])


@query("j4_pair", with_views("SELECT sample_id, view, a.label AS label, a.group_id AS group_id, round(a.probability, 6) AS left, round(b.probability, 6) AS right FROM scored a JOIN scored_b b USING (sample_id, view)", *BOTH))
def _(spark, d):
    return rounded(J.pair(V.scored(spark, d), V.scored(spark, d, "b", 0.8)).select("sample_id", "view", "label", "group_id", "left", "right"))


@query("j5_paired_views", with_views("SELECT s.sample_id, s.view, round(b.probability, 6) AS base_p, round(s.probability, 6) AS stress_p FROM scored s JOIN scored b ON b.sample_id = s.sample_id AND b.view = 'clean' WHERE s.view IN ('web', 'hard')", *BASE))
def _(spark, d):
    return rounded(J.paired_views(V.scored(spark, d), "clean", ["web", "hard"]))


@query("j6_attach_clean", with_views("SELECT sample_id, view, round(max(probability) FILTER (view = 'clean') OVER (PARTITION BY sample_id), 6) AS clean_p FROM scored", *BASE))
def _(spark, d):
    from ..operators.slices import attach_clean

    return rounded(attach_clean(V.scored(spark, d)).select("sample_id", "view", "clean_p"))


_XOR = "bit_count(xor(('0x' || substr(x.phash, 1, 8))::BIGINT, ('0x' || substr(y.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(x.phash, 9, 8))::BIGINT, ('0x' || substr(y.phash, 9, 8))::BIGINT))"


def near_sql(distance: int) -> str:
    return with_views(f""", one AS (SELECT phash, role, content_sha256, min(sample_id) AS sample_id FROM fingerprints GROUP BY ALL)
    SELECT x.sample_id AS a, y.sample_id AS b, ({_XOR})::INT AS distance FROM one x JOIN one y ON x.sample_id < y.sample_id AND x.role <> y.role AND x.content_sha256 <> y.content_sha256 WHERE {_XOR} <= {distance}""", "fingerprints")


@query("j7_near_pairs", near_sql(4))
def _(spark, d):
    """J7 with P15-P17; the SQL compares all pairs."""
    return J.near_pairs(V.fingerprints(spark, d), 4)


@query("j7_near_pairs_wide", near_sql(16))
def _(spark, d):
    return J.near_pairs(V.fingerprints(spark, d), 16)


_J8 = with_views(f""", df AS (SELECT * FROM fingerprints WHERE role = 'train'), pr AS (SELECT * FROM fingerprints WHERE role <> 'train')
    SELECT x.sample_id, min(CASE WHEN x.content_sha256 = y.content_sha256 THEN 'exact' ELSE 'near' END) AS reason FROM df x JOIN pr y ON x.content_sha256 = y.content_sha256 OR {_XOR} <= 4 GROUP BY 1""", "fingerprints")


@query("j8_decontaminate", _J8)
def _(spark, d):
    f = V.fingerprints(spark, d)
    return J.decontaminate(P.by_role(f, ["train"]), P.protected_rows(f, False))


@query("j8_kept_index", _J8)
def _(spark, d):
    """The same through an index that got the protected rows in two parts. Hashes are found once; there are as many buckets as a shuffle has partitions, so lookups read them as they are."""
    f = written(V.fingerprints(spark, d).select("sample_id", "phash", "content_sha256", "role"), "fingerprints")
    protected = written(P.protected_rows(f, False), "protected")
    path = folder(spark, "index")
    index = HashIndex(spark, path.rsplit("/", 1)[-1].replace("-", "_"), path, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    for role in ("calibration", "test"):
        index.add(protected.where(F.col("role") == role))
    return index.decontaminate(P.by_role(f, ["train"]))


@query("j9_exclude_hashes", with_views("SELECT sample_id FROM manifest WHERE role = 'train' AND content_sha256 NOT IN (SELECT content_sha256 FROM manifest WHERE role = 'test')", "manifest"))
def _(spark, d):
    m = V.manifest(spark, d)
    return J.exclude_hashes(P.by_role(m, ["train"]), P.by_role(m, ["test"])).select("sample_id")


@query("j10_rehydrate", with_views("SELECT sample_id, m.content_sha256, p AS path FROM manifest m LEFT JOIN (SELECT sha256(text) AS content_sha256, min('files/' || doc_id) AS p FROM documents WHERE lang <> 'de' GROUP BY 1) USING (content_sha256)", "manifest"))
def _(spark, d):
    files = V.table(spark, d, "documents").where("lang <> 'de'").select(F.sha2("text", 256).alias("content_sha256"), F.concat(F.lit("files/"), "doc_id").alias("path"))
    return J.rehydrate(V.manifest(spark, d).select("sample_id", "content_sha256"), files, allow_missing=True)


@query("j11_enrich", """SELECT c_custkey, coalesce(v, -1) AS value, coalesce(t, 'none') AS event_type FROM customer LEFT JOIN (
    SELECT user_id, max_by(value, event_id) AS v, max_by(event_type, event_id) AS t FROM events WHERE event_type <> 'error' GROUP BY user_id) ON user_id = c_custkey""")
def _(spark, d):
    a = V.table(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", "failed")).withColumnRenamed("user_id", "c_custkey")
    return J.enrich(V.table(spark, d, "customer").select("c_custkey"), a, "c_custkey", {"value": -1.0, "event_type": "none"}, "event_id")


@query("j12_pick_partner", with_views(""", pool AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS p, count(*) OVER () AS n FROM manifest WHERE label = 0),
    i AS (SELECT m.sample_id, (('0x' || substr(sha256('bg' || chr(0) || m.sample_id), 1, 16))::UBIGINT % (SELECT max(n) FROM pool)::UBIGINT)::BIGINT AS i FROM manifest m)
    SELECT i.sample_id, CASE WHEN a.sample_id = i.sample_id AND a.n > 1 THEN b.sample_id ELSE a.sample_id END AS partner FROM i JOIN pool a ON a.p = i.i JOIN pool b ON b.p = (i.i + 1) % b.n""", "manifest"))
def _(spark, d):
    m = V.manifest(spark, d)
    return J.pick_partner(m.select("sample_id"), m.where("label = 0"), "bg").select("sample_id", "partner")


@query("j13_strict_lookup", with_views("SELECT group_id, label, count(*) AS n FROM ledger JOIN manifest USING (sample_id) GROUP BY ALL", *ML))
def _(spark, d):
    return J.strict_lookup(V.ledger(spark, d), V.manifest(spark, d)).groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("j14_pending", with_views("SELECT sample_id, view FROM ledger WHERE error IS NOT NULL UNION ALL SELECT sample_id, 'tiny' FROM manifest", *ML))
def _(spark, d):
    return J.pending(V.manifest(spark, d), [*VIEWS, "tiny"], V.ledger(spark, d), retry_errors=True)


@query("j15_common_support", with_views(""", b AS (SELECT sample_id, view FROM ledger_b WHERE view <> 'hard' OR error IS NULL), s AS (SELECT DISTINCT sample_id FROM ledger JOIN b USING (sample_id)), x AS (SELECT sample_id, view FROM ledger JOIN b USING (sample_id, view))
    SELECT sample_id, view FROM x WHERE view IN (SELECT view FROM x GROUP BY view HAVING count(*) = (SELECT count(*) FROM s))""", *ML, "ledger_b"))
def _(spark, d):
    return J.common_support(V.ledger(spark, d), V.ledger(spark, d, "b", 0.8).where("view <> 'hard' or error is null"))


@query("j16_weighted_draw", """WITH w AS (SELECT source, n, sum(n) OVER (ORDER BY source) AS hi, sum(n) OVER () AS t FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
    q AS (SELECT o_orderkey, ('0x' || substr(sha256('draw' || chr(0) || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders)
    SELECT o_orderkey, source FROM q JOIN w ON u >= (hi - n)::DOUBLE / t AND u < hi::DOUBLE / t""")
def _(spark, d):
    w = V.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    q = V.table(spark, d, "orders").select("o_orderkey", S.uniform("draw", F.col("o_orderkey")).alias("u"))
    return J.weighted_draw(q, w).select("o_orderkey", "source")


@query("u1_union_manifests", "SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang, NULL::BIGINT AS price FROM documents UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, round(p_retailprice)::BIGINT FROM part")
def _(spark, d):
    a = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "lang")
    b = V.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.round("p_retailprice").cast("long").alias("price"))
    return U.union_manifests(a, b)


@query("u2_key_difference", "SELECT DISTINCT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    a, b = V.table(spark, d, "orders").select(F.col("o_custkey").alias("key")), V.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return U.key_difference(a, b, ["key"])[0]


@query("u3_common_views", with_views("SELECT view FROM ledger INTERSECT SELECT view FROM ledger_b WHERE view <> 'clean'", *ML, "ledger_b"))
def _(spark, d):
    return U.common_views(V.ledger(spark, d), V.ledger(spark, d, "b", 0.8))


@query("u4_missing_families", "SELECT f AS family FROM (VALUES ('click'), ('teleport'), ('view')) t(f) WHERE f NOT IN (SELECT event_type FROM events)")
def _(spark, d):
    return U.missing_families(V.table(spark, d, "events").select(F.col("event_type").alias("family")), ["click", "teleport", "view"])


@query("u5_relabel_role", with_views("SELECT sample_id, 'test' AS role FROM manifest WHERE role = 'calibration'", "manifest"))
def _(spark, d):
    return U.relabel_role(V.manifest(spark, d), "calibration", "test").select("sample_id", "role")
