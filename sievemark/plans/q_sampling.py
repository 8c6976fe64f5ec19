"""Queries: windows, samples, folds, bootstrap and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import resample as X
from ..operators import sampling as W
from ..operators import slices as G
from . import views as V
from .q_metrics import _HEALTH, BASE, BOTH, auc_sql, canary, paired, rounded
from .registry import query
from .views import THRESHOLD as T
from .views import with_views

R = 40


def prio(*parts: str, length: int = 16) -> str:
    return f"substr(sha256({' || chr(0) || '.join(parts)}), 1, {length})"


def u(*parts: str) -> str:
    return f"(('0x' || {prio(*parts, length=8)})::BIGINT / 4294967296.0::DOUBLE)"


CAPS = {f"src{i}": 3 + i for i in range(20)}
_CAP = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items()) + " ELSE 0 END"
_PR = prio("'7'", "source", "doc_id")


@query("w1_capped_sample", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_PR}, doc_id DESC) AS k FROM documents) WHERE k <= {_CAP}")
def _(spark, d):
    """The cap is the feature."""
    return W.capped_sample(V.table(spark, d, "documents"), "source", CAPS, 7, "doc_id").select("doc_id", "source")


@query("w2_quota_sample", with_views(f""", dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {prio("'7'", 'source', 'sample_id')}, sample_id DESC) AS k FROM manifest WHERE role <> 'test') WHERE k <= 11),
    f AS (SELECT * EXCLUDE (k, kk) FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY sample_id) AS kk FROM dr WHERE content_sha256 NOT IN (SELECT content_sha256 FROM manifest WHERE role = 'test')) WHERE kk = 1)
    SELECT sample_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {prio("'7'", 'source', 'sample_id')}, sample_id DESC) AS k FROM f) WHERE k <= 10""", "manifest"))
def _(spark, d):
    """Quotas are the feature."""
    m = V.manifest(spark, d)
    return W.quota_sample(m.where("role <> 'test'"), "source", {s: 10 for s in CAPS}, 7, "sample_id", m.where("role = 'test'"), strict=False).select("sample_id", "source")


@query("w3_round_robin", with_views(f"""SELECT sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, source) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY {prio("'3'", 'sample_id')}, sample_id) AS turn FROM manifest)) WHERE k <= 30""", "manifest"))
def _(spark, d):
    return W.round_robin_subset(V.manifest(spark, d), 60, 3).select("sample_id", "label")


@query("w4_first_by_hash", with_views("SELECT sample_id FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY role, sample_id) AS k FROM manifest WHERE role <> 'test' AND content_sha256 NOT IN (SELECT content_sha256 FROM manifest WHERE role = 'test')) WHERE k = 1", "manifest"))
def _(spark, d):
    m = V.manifest(spark, d)
    return W.first_by_hash(m.where("role <> 'test'"), m.where("role = 'test'")).select("sample_id")


@query("w5_dedup_provenance", "SELECT doc_id, source, kept_doc_id, kept_source FROM (SELECT doc_id, source, row_number() OVER w AS k, first(doc_id) OVER w AS kept_doc_id, first(source) OVER w AS kept_source FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)) WHERE k > 1")
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_sha256"))
    return W.dedup_with_provenance(docs, "doc_id", ["doc_id", "source"])[1].drop("content_sha256")


@query("w6_group_folds", with_views(f""", g AS (SELECT label, group_id, row_number() OVER (PARTITION BY label ORDER BY {prio("'5'", 'group_id')}, group_id) - 1 AS i FROM (SELECT DISTINCT label, group_id FROM manifest)),
    k AS (SELECT least(min(n), 4) AS k FROM (SELECT label, count(*) AS n FROM g GROUP BY label))
    SELECT sample_id, (i % k)::INT AS fold, true AS grouped FROM manifest JOIN g USING (label, group_id), k""", "manifest"))
def _(spark, d):
    return W.group_folds(V.manifest(spark, d), 4, 5).select("sample_id", F.col("fold").cast("int").alias("fold"), "grouped")


@query("w7_logo_folds", with_views(""", g AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS f FROM (SELECT DISTINCT group_id FROM manifest WHERE label = 1))
    SELECT sample_id, (CASE WHEN label = 1 THEN f ELSE (('0x' || substr(sha256(sample_id), 1, 16))::UBIGINT % (SELECT count(*) FROM g)::UBIGINT)::BIGINT END)::INT AS fold FROM manifest LEFT JOIN g USING (group_id)""", "manifest"))
def _(spark, d):
    return W.logo_folds(V.manifest(spark, d)).select("sample_id", F.col("fold").cast("int").alias("fold"))


def candidate_scores(spark, d):
    """Views as candidates: macro score and AUC of each source."""
    s = V.scored(spark, d)
    return G.macro_score(s, T, ("source",)).join(M.roc_auc(s, ["source"]), "source").withColumnRenamed("source", "model").withColumn("eligible", F.col("auc").isNotNull() & (F.col("macro_score") >= 0.5))


@query("w8_rank_candidates", with_views(f""", m AS (SELECT source, avg(x) AS macro_score FROM (SELECT source, label, avg(rate) AS x FROM (SELECT source, label, group_id, avg((CASE WHEN label = 1 THEN probability >= {T} ELSE probability < {T} END)::INT) AS rate FROM scored GROUP BY ALL) GROUP BY ALL) GROUP BY source),
    e AS (SELECT source AS model, macro_score, auc, auc IS NOT NULL AND macro_score >= 0.5 AS eligible FROM m JOIN ({auc_sql('scored', 'source')}) USING (source))
    SELECT model, round(macro_score, 6) AS macro_score, round(auc, 6) AS auc, eligible, row_number() OVER (ORDER BY eligible DESC, round(macro_score, 9) DESC, round(auc, 9) DESC NULLS LAST, model) AS rank FROM e""", *BASE))
def _(spark, d):
    s = candidate_scores(spark, d).withColumn("macro_score", F.round("macro_score", 9)).withColumn("auc", F.round("auc", 9))
    return rounded(W.rank_candidates(s))


@query("w11_misses", with_views(f"SELECT sample_id, round(probability, 6) AS probability FROM scored WHERE view = 'clean' AND label = 1 AND probability < {T}", *BASE))
def _(spark, d):
    return rounded(W.misses(V.scored(spark, d), "clean", T).select("sample_id", "probability"))


@query("w13_canary_summary", f"""WITH {_HEALTH} SELECT (SELECT run_id FROM health WHERE healthy ORDER BY last_loss, slope_100, gradient_p95, run_id LIMIT 1) AS healthiest,
    (SELECT run_id FROM health WHERE healthy ORDER BY last_score DESC, best_score DESC, run_id LIMIT 1) AS best_validation, (SELECT run_id FROM health WHERE healthy AND run_id % 3 <> 0 ORDER BY last_score DESC, best_score DESC, run_id LIMIT 1) AS recommended,
    (SELECT count(*) FROM health WHERE healthy) AS healthy_runs, count(DISTINCT points) = 1 AS equal_steps, count(DISTINCT points) = 1 AS equal_samples FROM health""")
def _(spark, d):
    """W13, I16."""
    return W.canary_summary(G.curve_health(*canary(spark, d)))


_SUMS = f"cs AS (SELECT label, sample_id, count(*) AS rows, sum((CASE WHEN label = 1 THEN probability >= {T} ELSE probability < {T} END)::INT) AS ok, sum((probability - label) ** 2) AS brier FROM scored GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM cs)"
_DRAWS = f"w AS (SELECT rep, label, i, count(*) AS weight FROM (SELECT rep, label, floor({u(chr(39) + '11' + chr(39), 'rep', 'label', 'i')} * n)::INT AS i FROM c, range({R}) t(rep)) GROUP BY ALL)"


def iv(name: str) -> str:
    return f"SELECT '{name}' AS metric, round(quantile_cont({name}, 0.025), 6) AS low, round(quantile_cont({name}, 0.975), 6) AS high, round(avg({name}), 6) AS mean FROM st"


@query("x1_clustered_bootstrap", with_views(f""", {_SUMS}, {_DRAWS}, s0 AS (SELECT rep, sum(ok * weight) FILTER (label = 1) / sum(rows * weight) FILTER (label = 1) AS recall, sum(ok * weight) FILTER (label = 0) / sum(rows * weight) FILTER (label = 0) AS specificity,
    sum(brier * weight) / sum(rows * weight) AS brier FROM w JOIN c USING (label, i) GROUP BY rep), st AS (SELECT *, (recall + specificity) / 2 AS balanced_accuracy FROM s0)
    {' UNION ALL '.join(map(iv, ['balanced_accuracy', 'recall', 'specificity', 'brier']))}""", *BASE))
def _(spark, d):
    """With a hash for each slot, as SQL can draw too; the tree is x1_bootstrap_report's."""
    return rounded(X.clustered_bootstrap(V.scored(spark, d), R, 11, T, draws="slots"))


@query("x1_bootstrap_report")
def _(spark, d):
    return rounded(X.bootstrap_report(V.scored(spark, d), R, 11, T))


@query("x1_bootstrap_auc")
def _(spark, d):
    return rounded(X.bootstrap_auc(V.scored(spark, d), R, 11))


@query("x2_paired_bootstrap")
def _(spark, d):
    return rounded(X.paired_bootstrap(paired(spark, d), R, 11, T))


@query("x3_hierarchical_bootstrap")
def _(spark, d):
    return rounded(X.hierarchical_bootstrap(V.scored(spark, d), R, 11, T))


@query("x3b_group_auc_bootstrap")
def _(spark, d):
    return rounded(X.group_auc_bootstrap(V.scored(spark, d), V.scored(spark, d, "b", 0.8), R, 11))


_STEP = lambda l: f"""SELECT step, {l} AS label, slot, {u("'9'", 'step', f"'{l}'", 'slot')} AS uu, {u("'9'", "'row'", 'step', f"'{l}'", 'slot')} AS ur FROM range(3, 40) a(step), range(16) b(slot)"""


@query("x4_balanced_plan", with_views(f""", sw AS (SELECT label, source, count(*) AS n, sqrt(count(*)) AS w FROM manifest GROUP BY ALL), cum AS (SELECT *, sum(w) OVER (PARTITION BY label ORDER BY source) AS hi, sum(w) OVER (PARTITION BY label) AS t FROM sw),
    sl AS ({_STEP(0)} UNION ALL {_STEP(1)}), rr AS (SELECT label, source, sample_id, row_number() OVER (PARTITION BY label, source ORDER BY sample_id) - 1 AS i FROM manifest)
    SELECT step, sl.label, slot, cum.source, sample_id FROM sl JOIN cum ON sl.label = cum.label AND uu >= (hi - w) / t AND uu < hi / t JOIN rr ON rr.label = sl.label AND rr.source = cum.source AND rr.i = floor(ur * cum.n)""", "manifest"))
def _(spark, d):
    """X4 with J16. The plan's length is set by its steps; its sources and rows come from the whole manifest."""
    return X.balanced_plan(V.manifest(spark, d), range(3, 40), 32, 9, 0.5).drop("draw_seed")


@query("x5_expand_views", with_views(f"SELECT sample_id, case_id, CAST(('0x' || {prio(chr(39) + '1' + chr(39), 'sample_id', 'case_id')})::UBIGINT AS VARCHAR) AS draw_seed FROM manifest, (VALUES ('clean'), ('jpeg_q75'), ('resize_64')) t(case_id)", "manifest"))
def _(spark, d):
    reg = spark.createDataFrame([("clean",), ("jpeg_q75",), ("resize_64",)], "case_id string")
    return X.expand_views(V.manifest(spark, d).select("sample_id"), reg, 1).withColumn("draw_seed", F.col("draw_seed").cast("string"))
