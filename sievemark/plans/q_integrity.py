"""Queries: scalar functions, audits and corpus assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import integrity as I
from ..operators import sampling as W
from . import views as V
from .q_joins import _XOR
from .q_metrics import BASE, rounded
from .q_sampling import prio
from .registry import query
from .views import THRESHOLD as T
from .views import with_views


@query("p1_scores", with_views(f"""SELECT sample_id, view, round(1 / (1 + exp(-raw_logit)), 6) AS p, round(1 / (1 + exp(-(raw_logit * 2 - 0.5))), 6) AS calibrated, round(ln({T} / (1 - {T})), 6) AS boundary,
    CASE WHEN label = 1 THEN probability >= {T} ELSE probability < {T} END AS correct, round(-CASE WHEN label = 1 THEN ln(greatest(probability, 1e-12)) ELSE ln(1 - least(probability, 1 - 1e-12)) END, 6) AS loss FROM scored""", *BASE))
def _(spark, d):
    """P1-P5."""
    x, l, p = F.col("raw_logit"), F.col("label"), F.col("probability")
    return rounded(V.scored(spark, d).select("sample_id", "view", S.sigmoid(x).alias("p"), S.calibrate(x, 2.0, -0.5).alias("calibrated"), S.logit(T).alias("boundary"), S.correct(l, p, T).alias("correct"), S.log_loss_row(l, p).alias("loss")))


_PART = "SELECT p_partkey, greatest(p_size, 1)::DOUBLE AS w, greatest(length(p_name), 1)::DOUBLE AS h, p_retailprice AS n, CASE p_partkey % 5 WHEN 0 THEN 'image/JPEG' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN '' END AS mime, CASE p_partkey % 3 WHEN 0 THEN 'cc' WHEN 1 THEN '' END AS lic FROM part"


@query("p9_metadata_features", f"""SELECT p_partkey, round(ln(w), 6) AS log_width, round(ln(h), 6) AS log_height, round(ln(w / h), 6) AS log_aspect, round(ln(w * h), 6) AS log_pixels, round(ln(1 + n), 6) AS log_bytes, round(n / (w * h), 6) AS bytes_per_pixel,
    (w = h)::DOUBLE AS is_square, coalesce(lower(mime) LIKE '%jpeg%', false)::DOUBLE AS is_jpeg, coalesce(mime LIKE '%png%', false)::DOUBLE AS is_png, coalesce(mime LIKE '%webp%', false)::DOUBLE AS is_webp, coalesce(lic <> '', false)::DOUBLE AS has_license FROM ({_PART})""")
def _(spark, d):
    k = F.col("p_partkey")
    mime = F.when(k % 5 == 0, "image/JPEG").when(k % 5 == 1, "image/png").when(k % 5 == 2, "image/webp").when(k % 5 == 3, "")
    f = S.metadata_features(F.col("p_size"), F.length("p_name"), F.col("p_retailprice"), mime, F.when(k % 3 == 0, "cc").when(k % 3 == 1, ""))
    return rounded(V.table(spark, d, "part").select("p_partkey", *f))


@query("p10_hashes", f"""SELECT doc_id, {prio('lang', 'source', 'doc_id', length=24)} AS content_id, {prio("'1'", "'ns'", 'doc_id')} AS priority, (('0x' || {prio('doc_id::VARCHAR')})::UBIGINT % 7)::INT AS fold,
    ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 0 AS holdout, CAST(('0x' || {prio("'5'", 'doc_id', 'lang')})::UBIGINT AS VARCHAR) AS draw_seed FROM documents""")
def _(spark, d):
    """P10-P14."""
    i, l = F.col("doc_id"), F.col("lang")
    return V.table(spark, d, "documents").select(
        "doc_id", S.content_id(l, F.col("source"), i).alias("content_id"), S.priority("1", "ns", i).alias("priority"), S.hash_fold(7, i).alias("fold"),
        S.hash_holdout(F.sha2(i.cast("string"), 256), 10).alias("holdout"), S.draw_seed(5, i, l).cast("string").alias("draw_seed"),
    )


@query("p15_hamming_bands", with_views("""SELECT id, phash, (bit_count(('0x' || substr(phash, 1, 8))::BIGINT) + bit_count(('0x' || substr(phash, 9, 8))::BIGINT))::INT AS ones, ('0x' || substr(phash, 1, 2))::INT * 32 + ('0x' || substr(phash, 3, 2))::INT // 8 AS first_band, phash SIMILAR TO '[0-9a-f]{16}' AS ok FROM fingerprints""", "fingerprints"))
def _(spark, d):
    """P15-P18."""
    h = F.col("phash")
    return V.fingerprints(spark, d).select("id", "phash", S.hamming(h, F.lit("0" * 16)).alias("ones"), F.element_at(S.bands(h, 4), 1)["bits"].alias("first_band"), S.is_hex(h, 16).alias("ok"))


@query("p19_names", """SELECT event_id, CASE WHEN event_type IN ('view') THEN 0 WHEN event_type IN ('click') THEN 1 END AS label, event_type || ':' || CASE WHEN value > 50 THEN 'fake' ELSE 'real' END || ':' || user_id AS group_name, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'x' || event_type END AS source_name,
    sha256(trim(regexp_replace(props, '\\s+', ' ', 'g'))) AS prompt_hash FROM events""")
def _(spark, d):
    """P19-P21."""
    t = F.col("event_type")
    alias = S.label_alias(F.when(t == "view", "REAL").when(t == "click", "ai").otherwise("other"))
    g = S.group_name(t, (F.col("value") > 50).cast("int"), F.col("user_id").cast("string"))
    name = S.source_name(F.concat(F.when(F.col("event_id") % 2 == 0, "HuggingFace:").otherwise("x"), t))
    return V.table(spark, d, "events").select("event_id", alias.alias("label"), g.alias("group_name"), name.alias("source_name"), S.prompt_hash(F.col("props")).alias("prompt_hash"))


@query("p22_slug", "SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 120), ''), 'unknown') AS slug, CASE WHEN regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) <> '' THEN CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'jpeg' THEN 'jpg' ELSE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) END ELSE 'png' END AS extension FROM pages")
def _(spark, d):
    """P22, P23."""
    return V.table(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug"), S.extension(F.col("url"), F.lit("image/png")).alias("extension"))


@query("p24_sniff", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'jpg' WHEN doc_id % 3 = 1 THEN 'png' ELSE lang END AS format, sha256(text) AS digest FROM documents")
def _(spark, d):
    """Magic bytes are put before the texts."""
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFD8FFE000"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("00")))
    docs = V.table(spark, d, "documents")
    body = S.assert_bytes(F.col("text").cast("binary"), F.sha2("text", 256))
    return docs.select("doc_id", S.sniff(F.concat(head, F.col("text").cast("binary")), F.col("lang")).alias("format"), F.sha2(body, 256).alias("digest"))


@query("p27_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS size, round(list_sum(embedding::DOUBLE[]) * 0.5 + 1, 5) AS score FROM embeddings")
def _(spark, d):
    """Size from the normalised vector's first part."""
    e = V.table(spark, d, "embeddings")
    v = F.col("embedding")
    n = S.l2_normalize(v)
    k = F.array_max(F.transform(v, lambda x: F.abs(x)))
    big = F.array_max(F.transform(n, lambda x: F.abs(x)))
    return e.select("vec_id", F.round(k.cast("double") / big, 5).alias("size"), F.round(S.linear_score(v, F.array_repeat(F.lit(0.5).cast("double"), 64), 1.0), 5).alias("score"))


_ISSUE = lambda code, key, having: f"""SELECT '{code}' AS code, {key} AS key, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS roles,
    array_to_string(list_sort(list(sample_id))[1:20], ',') AS members FROM m GROUP BY {key} HAVING {having}"""
_REPEATED = "m AS (SELECT * REPLACE (source AS group_id) FROM manifest UNION ALL SELECT * REPLACE (source AS group_id, 'test' AS role) FROM manifest WHERE line % 17 = 0)"


@query("g22_overlap_issues", with_views(f", {_REPEATED} " + " UNION ALL ".join([_ISSUE("duplicate_sample_id", "sample_id", "count(*) > 1"), _ISSUE("group_crosses_roles", "group_id", "count(DISTINCT role) > 1"), _ISSUE("exact_overlap", "content_sha256", "count(DISTINCT role) > 1")]), "manifest"))
def _(spark, d):
    """Some rows come twice, the second time in another role."""
    m = V.manifest(spark, d).withColumn("group_id", F.col("source"))
    return I.overlap_issues(m.unionByName(m.where("line % 17 = 0").withColumn("role", F.lit("test"))))


@query("w10_examples", with_views("SELECT view, total, array_to_string(list_transform(k[1:5], lambda x: x.sample_id || '/' || x.view), ',') AS examples FROM (SELECT view, count(*) AS total, list({'sample_id': sample_id, 'view': view} ORDER BY sample_id) AS k FROM ledger WHERE error IS NOT NULL GROUP BY view)", "manifest", "ledger"))
def _(spark, d):
    """Failed predictions of each view: their number, and the first five."""
    found = W.examples(V.ledger(spark, d).where("error is not null"), ["sample_id", "view"], 5, ("view",))
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda x: F.concat_ws("/", x["sample_id"], x["view"])), ","))


@query("g23_hash_issues", with_views("SELECT 'bad_content_hash' AS code, count(*) FILTER (id % 7 = 0) AS n FROM fingerprints UNION ALL SELECT 'bad_phash', count(*) FILTER (id % 5 = 0) FROM fingerprints UNION ALL SELECT 'missing_file', count(*) FILTER (id % 3 = 0) FROM fingerprints", "fingerprints"))
def _(spark, d):
    f = V.fingerprints(spark, d).withColumn("content_sha256", F.when(F.col("id") % 7 == 0, "xyz").otherwise(F.col("content_sha256"))).withColumn("phash", F.when(F.col("id") % 5 == 0, "g" * 16).otherwise(F.col("phash")))
    return I.hash_issues(f.withColumn("path", F.col("sample_id")), f.where("id % 3 <> 0").select(F.col("sample_id").alias("path")))


@query("g24_corpus_audit", """WITH a AS (SELECT event_type AS model_id, event_id, sha256(CAST(event_id AS VARCHAR)) AS h, user_id % 2 AS rev FROM events WHERE value >= 10),
    p AS (SELECT model_id, count(*) AS n, count(DISTINCT event_id) AS jobs, count(DISTINCT h) AS contents, count(DISTINCT rev) AS revisions, count(*) FILTER (event_id % 11 = 0) AS without_file FROM a GROUP BY model_id)
    SELECT *, n AS expected, n = jobs AND contents = n AND revisions = 1 AND without_file = 0 AS valid FROM p""")
def _(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("model_id"), F.col("event_id").alias("job_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("content_sha256"), (F.col("user_id") % 2).alias("revision"), F.when(F.col("value") < 10, "low").alias("error"))
    return I.corpus_audit(e, e.where("job_id % 11 <> 0"), e.where("error is null").groupBy("model_id").agg(F.count(F.lit(1)).alias("expected")))


def planted(spark, d):
    return V.fingerprints(spark, d).withColumn("group_id", F.col("sample_id")).withColumn("path", F.col("sample_id"))


_NEAR = f"one AS (SELECT phash, role, content_sha256, min(sample_id) AS sample_id FROM fingerprints GROUP BY ALL), np AS (SELECT x.sample_id AS a, y.sample_id AS b, x.role AS ra, y.role AS rb FROM one x JOIN one y ON x.sample_id < y.sample_id AND x.role <> y.role AND x.content_sha256 <> y.content_sha256 WHERE {_XOR} <= 4)"


@query("i1_audit_manifest", with_views(f", {_NEAR} SELECT code, CASE code WHEN 'near_overlap' THEN (SELECT count(*) FROM np) ELSE 0 END AS n, CASE WHEN code = 'near_overlap' AND (SELECT count(*) FROM np) > 0 THEN 'error' ELSE 'ok' END AS severity FROM (VALUES ('duplicate_sample_id'), ('group_crosses_roles'), ('exact_overlap'), ('near_overlap'), ('bad_content_hash'), ('bad_phash'), ('missing_file')) t(code)", "fingerprints"))
def _(spark, d):
    return I.audit_manifest(planted(spark, d), 4)


@query("i2_drop_cross_role_near", with_views(f", {_NEAR} SELECT sample_id, role FROM fingerprints WHERE role <> 'train' AND NOT (role = 'calibration' AND sample_id IN (SELECT a FROM np WHERE 'train' NOT IN (ra, rb) UNION SELECT b FROM np WHERE 'train' NOT IN (ra, rb)))", "fingerprints"))
def _(spark, d):
    return I.drop_cross_role_near(planted(spark, d).where("role <> 'train'"), 4).select("sample_id", "role")


@query("i3_assemble_training", with_views("""SELECT role, label, source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY role, sample_id) AS k FROM manifest
    WHERE role <> 'test' AND content_sha256 NOT IN (SELECT content_sha256 FROM manifest WHERE role = 'test')) WHERE k = 1 GROUP BY ALL""", "manifest"))
def _(spark, d):
    m = V.manifest(spark, d)
    return I.assemble_training([m.where("role = 'train'"), m.where("role = 'calibration'")], m.where("role = 'test'"))[1]


@query("i3_assembled_rows", with_views("""SELECT sample_id, role, content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY role, sample_id) AS k FROM manifest
    WHERE role <> 'test' AND content_sha256 NOT IN (SELECT content_sha256 FROM manifest WHERE role = 'test')) WHERE k = 1""", "manifest"))
def _(spark, d):
    """The rows themselves; the counts are i3_assemble_training's."""
    m = V.manifest(spark, d)
    return I.assemble_training([m.where("role = 'train'"), m.where("role = 'calibration'")], m.where("role = 'test'"))[0].select("sample_id", "role", "content_sha256")


@query("i4_prepare_corpus", with_views(f""", s AS (SELECT *, ('0x' || substr(sha256(sample_id), 1, 8))::BIGINT % 10 = 0 AS held FROM fingerprints WHERE role = 'train'), pr AS (SELECT * FROM fingerprints WHERE role <> 'train'),
    bad AS (SELECT DISTINCT x.sample_id FROM s x JOIN pr y ON {_XOR} <= 4 WHERE NOT held), rk AS (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY {prio("'3'", 'label', 'sample_id')}, sample_id DESC) AS k FROM s WHERE NOT held AND sample_id NOT IN (SELECT sample_id FROM bad))
    SELECT s.sample_id, CASE WHEN held THEN 'holdout' WHEN bad.sample_id IS NOT NULL THEN 'near' WHEN k <= 50 THEN 'kept' ELSE 'capped' END AS decision FROM s LEFT JOIN bad USING (sample_id) LEFT JOIN rk USING (sample_id)""", "fingerprints"))
def _(spark, d):
    f = V.fingerprints(spark, d)
    return I.prepare_corpus(f.where("role = 'train'"), f.where("role <> 'train'"), 50, 10, 3)


@query("i5_normalize_corpus", """WITH r AS (SELECT lang AS repo, CAST(doc_id AS VARCHAR) AS locator, sha256(text) AS content_sha256 FROM documents)
    SELECT repo, locator, kept_repo, kept_locator FROM (SELECT *, row_number() OVER w AS k, first(repo) OVER w AS kept_repo, first(locator) OVER w AS kept_locator FROM r WINDOW w AS (PARTITION BY content_sha256 ORDER BY repo || chr(0) || locator)) WHERE k > 1""")
def _(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("locator"), F.col("source").alias("prompt"), F.col("source").alias("generator"), F.sha2("text", 256).alias("content_sha256"))
    return I.normalize_corpus([docs.where("repo = 'en'"), docs.where("repo <> 'en'")])[1].select("repo", "locator", "kept_repo", "kept_locator")
