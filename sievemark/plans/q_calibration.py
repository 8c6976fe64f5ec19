"""Queries: calibration, probes, reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibration as C
from ..operators import gates as Q
from ..operators import integrity as I
from ..operators import joins as J
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import slices as G
from . import views as V
from .q_metrics import _CASES, BASE, BOTH, CONFUSION, _OK, auc_sql, curves, family, rounded
from .q_sampling import candidate_scores
from .registry import query
from .views import THRESHOLD as T
from .views import with_views

VIEWS = [v for v, _ in V.VIEWS]
LOGIT = f"ln({T}::DOUBLE / (1 - {T}::DOUBLE))"
_BEST = """best AS (SELECT view, t FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY goal DESC, abs(t), t) AS k FROM (
    SELECT c.view, c.raw_logit AS t, sum(c.pos) OVER w * n + (n - sum(c.neg) OVER w) * p AS goal FROM (SELECT view, raw_logit, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY ALL) c
    JOIN (SELECT view, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY view) USING (view) WINDOW w AS (PARTITION BY view ORDER BY raw_logit DESC))) WHERE k = 1)"""


@query("m1_fit_calibrators", with_views(f", {_BEST} SELECT view, m AS method, 1.0::DOUBLE AS slope, CASE m WHEN 'bias' THEN round({LOGIT} - t, 6) ELSE 0 END::DOUBLE AS intercept, round(CASE m WHEN 'bias' THEN t ELSE {LOGIT} END, 6) AS boundary FROM best, (VALUES ('identity'), ('bias')) v(m)", *BASE))
def _(spark, d):
    return rounded(C.fit_calibrators(V.scored(spark, d), ("identity", "bias"), T, "view"))


@query("m2_platt")
def _(spark, d):
    return rounded(C.fit_calibrators(V.scored(spark, d), ("platt",), T, "view"), 5)


def calibration_rows(spark, d):
    """All labelled rows: roles may hold too few positive groups at small sizes."""
    return V.scored(spark, d)


@query("m3_select_calibrator")
def _(spark, d):
    return rounded(C.select_calibrator(calibration_rows(spark, d), T)[0], 5)


@query("m4_leakage_probe")
def _(spark, d):
    m = V.manifest(spark, d)
    none = F.lit(None).cast("string")
    rows = m.select("sample_id", "label", "group_id", "content_sha256", *S.metadata_features(F.col("width"), F.col("height"), F.col("n_bytes"), none, none))
    return rounded(L.leakage_probe(rows, ["log_width", "log_height", "log_aspect", "log_bytes", "bytes_per_pixel"], 3, 5), 4)


def probe_rows(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("sample_id"), (F.col("label") % 2).alias("label"), F.col("label").cast("string").alias("group_id"), F.when(F.col("vec_id") % 2 == 0, "calibration").otherwise("test").alias("role"), F.col("embedding").alias("features"), F.lit("clean").alias("view"))


@query("m5_linear_probe")
def _(spark, d):
    return rounded(L.linear_probe(probe_rows(spark, d), "features"), 4)


@query("m6_feature_coverage", "SELECT CAST(vec_id AS VARCHAR) AS sample_id, v AS view FROM embeddings, (VALUES ('clean'), ('web')) t(v) WHERE v = 'web' OR vec_id % 9 = 0")
def _(spark, d):
    p = probe_rows(spark, d)
    return L.feature_coverage(p, ["clean", "web"], p.withColumn("features", F.when(F.col("sample_id").cast("long") % 9 != 0, F.col("features"))))


@query("m7_score_to_ledger", "SELECT CAST(vec_id AS VARCHAR) AS sample_id, 'clean' AS view, CASE WHEN vec_id % 50 <> 0 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS raw_logit, CASE WHEN vec_id % 50 = 0 THEN 'ValueError: empty' END AS error, 'sum' AS model_id FROM embeddings")
def _(spark, d):
    def fn(batch):
        if any(v is None for v in batch):
            raise ValueError("empty")
        return batch.map(lambda v: sum(map(float, v)))

    p = probe_rows(spark, d).withColumn("features", F.when(F.col("sample_id").cast("long") % 50 != 0, F.col("features")))
    return rounded(L.score_to_ledger(p, fn, "features", "sum"), 4)


@query("m8_apply_calibrator", with_views(f"SELECT sample_id, view, round(1 / (1 + exp(-(raw_logit * 2 + {LOGIT} - 1))), 6) AS probability FROM scored", *BASE))
def _(spark, d):
    t = F.lit(0.5)
    c = spark.range(1).select(F.lit(2.0).alias("slope"), (S.logit(T) - 1).alias("intercept"), t.alias("boundary"))
    return rounded(C.apply_calibrator(V.scored(spark, d), c, T).select("sample_id", "view", "probability"))


@query("i6_evaluation_gates")
def _(spark, d):
    """Over the samples whose predictions are all there, as a report demands."""
    m = V.manifest(spark, d).withColumn("role", F.when(F.conv(F.substring("content_sha256", 1, 4), 16, 10).cast("int") % 2 == 0, "calibration").otherwise("test"))
    audit = I.audit_manifest(m.withColumn("phash", F.substring("content_sha256", 1, 16)), 4)
    valid = V.ledger(spark, d).where("error is null")
    whole = valid.groupBy("sample_id").count().where(F.col("count") == len(VIEWS)).select("sample_id")
    return rounded(Q.evaluation_report(m.join(whole, "sample_id", "left_semi"), valid, audit, VIEWS, T, 50, 3)["gates"], 5)


_C2 = _CASES.replace("FROM scored)", "FROM rescored)")


@query("i7_redteam_gates", with_views(f""", rescored AS (SELECT * REPLACE (1 / (1 + exp(-(raw_logit * 2 + {LOGIT} - 1))) AS probability) FROM scored), {_C2},
    m AS (SELECT min((tp / (tp + fn) + tn / (tn + fp)) / 2) AS ba, min(tp / (tp + fn)) FILTER (view = 'hard') AS rc FROM cases WHERE view <> 'clean')
    SELECT g AS gate, round(v, 6) AS value, b AS bound, CASE WHEN ge THEN v >= b ELSE v <= b END AS passed FROM (
        SELECT 'protocol_problems <= 0' AS g, (SELECT count(*) FROM ledger WHERE view_pos <> CASE view WHEN 'clean' THEN 0 WHEN 'web' THEN 1 ELSE 3 END)::DOUBLE AS v, 0::DOUBLE AS b, false AS ge UNION ALL SELECT 'worst_balanced_accuracy >= 0.75', ba, 0.75, true FROM m
        UNION ALL SELECT 'critical_recall >= 0.6', rc, 0.6, true FROM m
        UNION ALL SELECT 'missing_families <= 0', (SELECT count(*) FROM (VALUES ('resize'), ('crop')) f(x) WHERE x NOT IN (SELECT CASE WHEN view = 'clean' THEN 'none' ELSE 'resize' END FROM cases)), 0, false)""", *BASE))
def _(spark, d):
    """The registry has another place for one view than the ledger."""
    reg = spark.createDataFrame([(v, i + (v == "hard"), "model-a") for i, v in enumerate(VIEWS)], "case_id string, view_pos int, model_id string")
    p = J.protocol_join(V.manifest(spark, d), V.ledger(spark, d), reg, ["view_pos", "model_id"])
    calibrator = spark.range(1).select(F.lit(2.0).alias("slope"), (S.logit(T) - 1).alias("intercept"), F.lit(0.5).alias("boundary"))
    return rounded(Q.redteam_report(V.scored(spark, d), p, calibrator, T, ["hard"], family(), ["resize", "crop"], 40, 5)["gates"])


@query("i8_compare")
def _(spark, d):
    return rounded(Q.compare(V.scored(spark, d), V.scored(spark, d, "b", 0.8), T, 40, 11)["intervals"])


def tournament(spark, d):
    """Models a and b on calibration rows; every sample of the manifest is one here."""
    m = V.manifest(spark, d).withColumn("role", F.lit("calibration"))
    return Q.rank_tournament(m, {"a": V.ledger(spark, d), "b": V.ledger(spark, d, "b", 0.8)}, T, {"a": False, "b": True})


@query("i9_rank_tournament")
def _(spark, d):
    return rounded(tournament(spark, d), 4)


def _vm(s: str) -> str:
    return f"(SELECT view, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba, tp / (tp + fn) AS recall, tn / (tn + fp) AS spec, auc FROM (SELECT view, {CONFUSION} FROM {s} GROUP BY view) JOIN ({auc_sql(s, 'view')}) USING (view))"


@query("i10_ablation_gates", with_views(f""", x AS {_vm('scored')}, y AS {_vm('scored_b')}, j AS (SELECT view, y.ba - x.ba AS ba, y.recall - x.recall AS rc, y.spec - x.spec AS sp FROM x JOIN y USING (view)),
    v AS (SELECT avg(ba) FILTER (view <> 'clean') AS c1, avg(ba) FILTER (view = 'hard') AS c2, avg(rc) FILTER (view <> 'clean') AS c3, avg(ba) FILTER (view = 'clean') AS c4, avg(sp) FILTER (view <> 'clean') AS c5 FROM j)
    SELECT g AS gate, round(v, 6) AS value, b AS bound, v >= b AS passed FROM (SELECT 'low_quality_balanced_accuracy >= 0.05' AS g, c1 AS v, 0.05::DOUBLE AS b FROM v UNION ALL SELECT 'critical_balanced_accuracy >= 0.05', c2, 0.05 FROM v
        UNION ALL SELECT 'low_quality_recall >= 0.08', c3, 0.08 FROM v UNION ALL SELECT 'clean_balanced_accuracy >= -0.01', c4, -0.01 FROM v UNION ALL SELECT 'low_quality_specificity >= -0.03', c5, -0.03 FROM v)""", *BOTH))
def _(spark, d):
    return rounded(Q.ablation_gates(M.view_metrics(V.scored(spark, d), T), M.view_metrics(V.scored(spark, d, "b", 0.8), T), F.col("view") != "clean", F.col("view") == "hard"))


@query("i11_promotion_gates", with_views(f""", x AS {_vm('scored')}, y AS {_vm('scored_b')}, lx AS {_vm("(SELECT * FROM scored WHERE width < 1500)")}, ly AS {_vm("(SELECT * FROM scored_b WHERE width < 1500)")},
    j AS (SELECT view, y.ba - x.ba AS ba FROM x JOIN y USING (view)), co AS (SELECT dataset, avg(rb) - avg(ra) AS rc FROM (SELECT dataset, view, avg((a.probability >= {T})::INT) AS ra FROM scored a WHERE label = 1 GROUP BY ALL) JOIN (SELECT dataset, view, avg((probability >= {T})::INT) AS rb FROM scored_b WHERE label = 1 GROUP BY ALL) USING (dataset, view) GROUP BY dataset),
    ca AS (SELECT view, {CONFUSION} FROM (SELECT * FROM scored WHERE sample_id IN (SELECT sample_id FROM scored WHERE view = 'clean')) GROUP BY view), cb AS (SELECT view, {CONFUSION} FROM (SELECT * FROM scored_b WHERE sample_id IN (SELECT sample_id FROM scored_b WHERE view = 'clean')) GROUP BY view),
    fam AS (SELECT (SELECT min((tp / (tp + fn) + tn / (tn + fp)) / 2) FROM cb WHERE view <> 'clean') - (SELECT min((tp / (tp + fn) + tn / (tn + fp)) / 2) FROM ca WHERE view <> 'clean') AS f),
    dis AS (SELECT avg(((1 / (1 + exp(-(a.raw_logit + 0.6))) >= {T}) <> (1 / (1 + exp(-(b.raw_logit + 0.6))) >= {T}))::INT) AS dr FROM scored a JOIN scored_b b USING (sample_id, view))
    SELECT g AS gate, round(v, 6) AS value, b AS bound, CASE WHEN ge THEN v >= b ELSE v <= b END AS passed FROM (SELECT view || '_balanced_accuracy >= -0.01' AS g, ba AS v, -0.01::DOUBLE AS b, true AS ge FROM j
        UNION ALL SELECT 'low_quality_balanced_accuracy >= 0.08', (SELECT avg(ba) FROM ly) - (SELECT avg(ba) FROM lx), 0.08, true UNION ALL SELECT 'low_quality_recall >= 0.15', (SELECT avg(recall) FROM ly) - (SELECT avg(recall) FROM lx), 0.15, true
        UNION ALL SELECT dataset || '_recall >= 0', rc, 0, true FROM co WHERE dataset IN ('en', 'de') UNION ALL SELECT 'family_balanced_accuracy >= 0.05', f, 0.05, true FROM fam UNION ALL SELECT 'disagreement_rate <= 0.005', dr, 0.005, false FROM dis)""", *BOTH))
def _(spark, d):
    """Low quality: small samples; cohorts: the positives of two languages."""
    a, b = V.scored(spark, d), V.scored(spark, d, "b", 0.8)
    small = F.col("width") < 1500
    cohort = lambda s, lang: G.positive_summary(s.where((F.col("label") == 1) & (F.col("dataset") == lang)), ["view"], T)
    families = lambda s: G.family_rollup(G.attack_cases(s, T).withColumn("family", family()))
    return rounded(Q.promotion_gates(
        M.view_metrics(a, T), M.view_metrics(b, T), M.view_metrics(a.where(small), T), M.view_metrics(b.where(small), T), {x: (cohort(a, x), cohort(b, x)) for x in ("en", "de")}, families(a), families(b), "resize", G.ledger_parity(a, b, 1.0, 0.6, T),
    ))


@query("i12_teacher_gate")
def _(spark, d):
    a, b = V.scored(spark, d), V.scored(spark, d, "b", 0.8)
    whole = a.unionByName(b).groupBy("sample_id").count().where("count = 6").select("sample_id")
    a, b = a.join(whole, "sample_id", "left_semi"), b.join(whole, "sample_id", "left_semi")
    return rounded(Q.teacher_gate(tournament(spark, d), "a", {"a": a, "b": b}, curves(spark, d).withColumn("score", F.col("loss")), 50.0, 30, 5))


_COHORT = f"""co AS (SELECT s.* FROM scored s WHERE label = 1 AND sample_id IN (SELECT sample_id FROM scored GROUP BY 1 HAVING count(*) = 3))"""


def cohort(spark, d):
    """Positives with a valid prediction for each view, as a cohort of test rows, with the attempts that made them: some fail, some are made again."""
    l = V.ledger(spark, d).where("error is null")
    whole = l.groupBy("sample_id").count().where("count = 3").select("sample_id")
    m = V.manifest(spark, d).where("label = 1").join(whole, "sample_id", "left_semi").withColumns({"role": F.lit("test"), "source": F.concat(F.lit("HuggingFace:"), "source")})
    made = lambda seq, error: m.select("content_sha256", F.concat(F.lit(f"slug{seq}-"), "dataset").alias("model_slug"), F.concat(F.lit("p"), "line").alias("prompt"), F.col("line").cast("string").alias("seed"), (F.lit(seq) * 1_000_000_000 + F.col("line")).alias("seq"), error.alias("error"), "line")
    first = made(1, F.when(F.col("line") % 4 == 0, "timeout")).where("line % 5 <> 0")
    attempts = first.unionByName(made(2, F.lit(None).cast("string")).where("line % 3 = 0"))
    calibrator = spark.range(1).select(F.lit(1.0).alias("slope"), F.lit(0.6).alias("intercept"), (S.logit(T) - 0.6).alias("boundary"))
    return Q.positive_cohort_report(m, attempts, l.join(m.select("sample_id"), "sample_id", "left_semi"), calibrator, "clean", ["web", "hard"], T)


@query("i13_positive_cohort", with_views(f", {_COHORT} SELECT view, count(*) AS n, count(*) FILTER (probability >= {T}) AS detected, round(avg(probability), 6) AS mean_p, round(avg((probability >= {T})::INT), 6) AS recall FROM co GROUP BY view", *BASE))
def _(spark, d):
    return rounded(cohort(spark, d)["views"].select("view", "n", "detected", "mean_p", "recall"))


@query("i13_cohort_rows", with_views(f""", {_COHORT}, la AS (SELECT content_sha256, max(seq) AS seq, arg_max(line, seq) AS l, arg_max(dataset, seq) AS ds FROM (SELECT content_sha256, 1000000000 + line AS seq, line, dataset FROM co WHERE line % 5 <> 0 AND line % 4 <> 0 UNION ALL
    SELECT content_sha256, 2000000000 + line, line, dataset FROM co WHERE line % 3 = 0) GROUP BY 1)
    SELECT sample_id, view, source, CASE WHEN seq IS NULL THEN '' ELSE 'slug' || seq // 1000000000 || '-' || ds END AS model_slug, coalesce('p' || l, '') AS prompt, coalesce(CAST(l AS VARCHAR), '') AS seed, round(raw_logit, 6) AS raw_logit, round(probability, 6) AS probability,
           probability >= {T} AS detected FROM co LEFT JOIN la USING (content_sha256)""", *BASE))
def _(spark, d):
    """Every row with the details of the attempt that made it."""
    return rounded(cohort(spark, d)["rows"])


@query("i14_final_summary", with_views(f""", x AS {_vm('scored')}, j AS (SELECT avg(((1 / (1 + exp(-(a.raw_logit + 0.6))) >= {T}) <> (1 / (1 + exp(-(b.raw_logit + 0.6))) >= {T}))::INT) AS dr FROM scored a JOIN scored_b b USING (sample_id, view)),
    s AS (SELECT sample_id, bool_and(probability >= {T}) AS a, bool_or(probability >= {T}) AS o FROM scored WHERE label = 1 GROUP BY 1),
    wv AS (SELECT sample_id, 'worst' AS view, label, CASE label WHEN 1 THEN min(probability) ELSE max(probability) END AS probability FROM scored GROUP BY sample_id, label), y AS {_vm('wv')}
    SELECT (SELECT view FROM x ORDER BY ba, view LIMIT 1) AS worst_view, (SELECT round(min(ba), 6) FROM x) AS worst_balanced_accuracy, (SELECT round(ba, 6) FROM y) AS robust_balanced_accuracy, (SELECT round(recall, 6) FROM y) AS robust_recall,
           (SELECT round(spec, 6) FROM y) AS robust_specificity, (SELECT round(auc, 6) FROM y) AS robust_auc,
           count(*) AS samples, round(avg(a::INT), 6) AS all_views, round(avg(o::INT), 6) AS any_view, (SELECT round(dr, 6) FROM j) AS disagreement_rate FROM s""", *BOTH))
def _(spark, d):
    return rounded(Q.final_summary(V.scored(spark, d), V.scored(spark, d, "b", 0.8), T))


@query("i15_gates", with_views("SELECT 'rows >= 100' AS gate, count(*)::DOUBLE AS value, 100::DOUBLE AS bound, count(*) >= 100 AS passed FROM manifest UNION ALL SELECT 'groups <= 10', count(DISTINCT group_id), 10, count(DISTINCT group_id) <= 10 FROM manifest", "manifest"))
def _(spark, d):
    return Q.gates(V.manifest(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups")), [("rows", ">=", 100), ("groups", "<=", 10)])


@query("w9_pick_calibrator")
def _(spark, d):
    return C.select_calibrator(calibration_rows(spark, d), T)[1].select("method", F.round("slope", 4).alias("slope"))
