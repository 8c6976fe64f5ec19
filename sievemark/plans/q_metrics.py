"""Queries: metrics, slices, groups and worst cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import slices as G
from . import views as V
from .registry import query
from .views import THRESHOLD as T
from .views import with_views

BASE = ("manifest", "ledger", "scored")
BOTH = (*BASE, "ledger_b", "scored_b")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


HIT = f"probability >= {T}"
CONFUSION = f"""count(*) FILTER (label = 1 AND {HIT}) AS tp, count(*) FILTER (label = 0 AND NOT {HIT}) AS tn,
    count(*) FILTER (label = 0 AND {HIT}) AS fp, count(*) FILTER (label = 1 AND NOT {HIT}) AS fn,
    count(*) AS n, count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_fake"""
RATES = ", ".join([
    r("tp / nullif(tp + fn, 0)", "recall"), r("tn / nullif(tn + fp, 0)", "specificity"), r("tp / nullif(tp + fp, 0)", "precision"), r("tn / nullif(tn + fn, 0)", "npv"),
    r("2 * tp / nullif(2 * tp + fp + fn, 0)", "f1"), r("(tp + tn) / (tp + tn + fp + fn)", "accuracy"),
    r("(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2", "balanced_accuracy"),
    r("(tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)", "mcc"),
])


def auc_sql(source: str, by: str, where: str = "true") -> str:
    """AUC by average ranks."""
    return f"""SELECT {by}, (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc
        FROM (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY probability) + (count(*) OVER (PARTITION BY {by}, probability) - 1) / 2 AS rk FROM {source} WHERE {where}) GROUP BY {by}"""


@query("a_confusion_rates", with_views(f"SELECT *, {RATES} FROM (SELECT view, {CONFUSION} FROM scored GROUP BY view)", *BASE))
def _(spark, d):
    """A1-A3."""
    return rounded(M.rates(M.confusion(V.scored(spark, d), ["view"], T)))


@query("a_metrics_by_view", with_views(f"""SELECT view, n, n_real, n_fake, {RATES}, round(auc, 6) AS auc
    FROM (SELECT view, {CONFUSION} FROM scored GROUP BY view) JOIN ({auc_sql('scored', 'view')}) USING (view)""".replace("SELECT view, n, n_real, n_fake,", "SELECT view, tp, tn, fp, fn, n, n_real, n_fake,"), *BASE))
def _(spark, d):
    """A1-A4 by view: the flagship."""
    s = V.scored(spark, d)
    return rounded(M.rates(M.confusion(s, ["view"], T)).join(M.roc_auc(s, ["view"]), "view"))


@query("a_rank_metrics", with_views(f""", auc AS ({auc_sql('scored', 'dataset, view')}),
    ap AS (SELECT dataset, view, sum(label * hits / rk) / sum(label) AS average_precision FROM (
        SELECT dataset, view, label, sum(label) OVER w AS hits, row_number() OVER w AS rk FROM scored WINDOW w AS (PARTITION BY dataset, view ORDER BY probability DESC, line, view_pos ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
    ece AS (SELECT dataset, view, sum(n * abs(p - l)) / sum(n) AS ece FROM (SELECT dataset, view, least(floor(probability * 15), 14) AS b, count(*) AS n, avg(probability) AS p, avg(label) AS l FROM scored GROUP BY ALL) GROUP BY ALL),
    ps AS (SELECT dataset, view, avg((probability - label) ** 2) AS brier, avg(-CASE WHEN label = 1 THEN ln(greatest(probability, 1e-12)) ELSE ln(1 - least(probability, 1 - 1e-12)) END) AS log_loss, count(DISTINCT sample_id) AS unique_images FROM scored GROUP BY ALL)
    SELECT dataset, view, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, round(ece, 6) AS ece, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, unique_images
    FROM auc JOIN ap USING (dataset, view) JOIN ece USING (dataset, view) JOIN ps USING (dataset, view)""", *BASE))
def _(spark, d):
    """A4-A7, A9 by dataset and view."""
    by = ["dataset", "view"]
    m = M.binary_metrics(V.scored(spark, d), by, T)
    return rounded(m.select(*by, "auc", "average_precision", "ece", "brier", "log_loss", "unique_images"))


@query("a8_optimal_threshold", with_views("""SELECT view, round(t, 6) AS threshold, round(goal / (2 * p * n), 6) AS balanced FROM (
        SELECT *, row_number() OVER (PARTITION BY view ORDER BY goal DESC, abs(t), t) AS k FROM (
            SELECT c.view, c.raw_logit AS t, sum(c.pos) OVER w * max(p) OVER () * 0 + sum(c.pos) OVER w * n + (n - sum(c.neg) OVER w) * p AS goal, p, n
            FROM (SELECT view, raw_logit, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY ALL) c
            JOIN (SELECT view, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY view) USING (view) WINDOW w AS (PARTITION BY view ORDER BY raw_logit DESC))) WHERE k = 1""".replace("sum(c.pos) OVER w * max(p) OVER () * 0 + ", ""), *BASE))
def _(spark, d):
    return rounded(M.optimal_threshold(V.scored(spark, d), ["view"]))


@query("a10_view_metrics", with_views(f"""SELECT view, n, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')}, {r('tp / (tp + fn)', 'recall')}, {r('tn / (tn + fp)', 'specificity')}, round(auc, 6) AS auc
    FROM (SELECT view, {CONFUSION} FROM scored GROUP BY view) JOIN ({auc_sql('scored', 'view')}) USING (view)""", *BASE))
def _(spark, d):
    return rounded(M.view_metrics(V.scored(spark, d), T))


_F = "SELECT 'view' AS field, view AS value, * FROM scored UNION ALL SELECT 'dataset', dataset, * FROM scored UNION ALL SELECT 'bucket', " \
    "CASE WHEN least(width, height) < 128 THEN '<128' WHEN least(width, height) < 256 THEN '128-255' WHEN least(width, height) < 512 THEN '256-511' WHEN least(width, height) < 1024 THEN '512-1023' ELSE '>=1024' END, * FROM scored"


_AP = """SELECT field, value, sum(label * hits / rk) / sum(label) AS average_precision FROM (SELECT field, value, label, sum(label) OVER w AS hits, row_number() OVER w AS rk FROM f
        WINDOW w AS (PARTITION BY field, value ORDER BY probability DESC, line, view_pos ROWS UNBOUNDED PRECEDING)) GROUP BY ALL"""
_ECE = "SELECT field, value, sum(n * abs(p - l)) / sum(n) AS ece FROM (SELECT field, value, least(floor(probability * 15), 14) AS b, count(*) AS n, avg(probability) AS p, avg(label) AS l FROM f GROUP BY ALL) GROUP BY ALL"
_LOSS = "avg(-CASE WHEN label = 1 THEN ln(greatest(probability, 1e-12)) ELSE ln(1 - least(probability, 1 - 1e-12)) END)"


@query("g1_slices", with_views(f""", f AS ({_F}), c AS (SELECT field, value, {CONFUSION}, avg((probability - label) ** 2) AS brier, {_LOSS} AS log_loss, count(DISTINCT sample_id) AS unique_images FROM f GROUP BY ALL)
    SELECT field, value, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, n, n_real, n_fake, unique_images, {r('tp / (tp + fn)', 'recall')}, {r('tn / (tn + fp)', 'specificity')}, {r('tp / nullif(tp + fp, 0)', 'precision')}, {r('tn / nullif(tn + fn, 0)', 'npv')},
           {r('2 * tp / nullif(2 * tp + fp + fn, 0)', 'f1')}, {r('(tp + tn) / n', 'accuracy')}, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')},
           {r('(tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)', 'mcc')},
           round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, round(ece, 6) AS ece
    FROM c JOIN ({auc_sql('f', 'field, value')}) USING (field, value) JOIN ({_AP}) USING (field, value) JOIN ({_ECE}) USING (field, value) WHERE n >= 20 AND n_real > 0 AND n_fake > 0""", *BASE))
def _(spark, d):
    """G1 with F4: every metric of every slice."""
    s = V.scored(spark, d).withColumn("bucket", S.resolution_bucket(F.col("width"), F.col("height")))
    return rounded(G.slices(s, ["view", "dataset", "bucket"], T))


_EFF = "CASE WHEN lim IS NOT NULL AND greatest(width, height) > lim THEN greatest(1, round_even(least(width, height)::DOUBLE * lim / greatest(width, height), 0)::BIGINT) ELSE least(width, height) END"
_OK = f"CASE WHEN label = 1 THEN probability >= {T} ELSE probability < {T} END::INT"


@query("g2_resolution_buckets", with_views(f""", e AS (SELECT *, {_EFF} AS short, {_OK} AS ok FROM (SELECT *, CASE view WHEN 'web' THEN 768 WHEN 'hard' THEN 512 END AS lim, coalesce(CASE line % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END, 440) AS edge FROM scored WHERE line % 11 <> 0))
    SELECT view, CASE WHEN least(width, height) < 128 THEN '<128' WHEN least(width, height) < 256 THEN '128-255' WHEN least(width, height) < 512 THEN '256-511' WHEN least(width, height) < 1024 THEN '512-1023' ELSE '>=1024' END AS bucket,
           CASE WHEN edge / short < 0.5 THEN 'down>2x' WHEN edge / short <= 1 THEN 'down<2x' WHEN edge / short <= 2 THEN 'up<=2x' ELSE 'up>2x' END AS scale, label,
           count(*) AS n, count(DISTINCT sample_id) AS unique_images, round(avg(ok), 6) AS rate, round(avg(probability), 6) AS mean_p, round(avg(least(width, height)), 6) AS mean_original_short, round(avg(short), 6) AS mean_short, arg_min(edge, line)::BIGINT AS short_edge, round(avg(edge / short), 6) AS mean_factor, CASE label WHEN 1 THEN 'fake_recall' ELSE 'real_specificity' END AS metric, string_agg(DISTINCT group_id, ',' ORDER BY group_id) AS groups
    FROM e GROUP BY ALL""", *BASE))
def _(spark, d):
    """G2 with P6-P8: models of several sizes, one of them unknown, and rows without dimensions, which are left out and counted."""
    edge = F.when(F.col("line") % 3 == 0, 256).when(F.col("line") % 3 == 1, 512)
    return rounded(G.resolution_buckets(sized(spark, d).withColumn("model_resize_short_edge", edge), T))


def sized(spark, d):
    return V.scored(spark, d).withColumn("width", F.when(F.col("line") % 11 != 0, F.col("width")))


@query("g2_missing_dimensions", with_views("SELECT count(*) FILTER (line % 11 = 0) AS missing_dimensions FROM scored", *BASE))
def _(spark, d):
    return G.missing_dimensions(sized(spark, d))


@query("g3_group_view_rates", with_views(f"SELECT view, group_id, label, count(*) AS n, round(avg({_OK}), 6) AS rate FROM scored GROUP BY ALL", *BASE))
def _(spark, d):
    return rounded(G.group_view_rates(V.scored(spark, d), T))


_GR = f"SELECT label, group_id, avg({_OK}) AS rate FROM scored GROUP BY ALL"


@query("g4_macro_tail", with_views(f"SELECT label, round(avg(rate), 6) AS macro_rate, round(quantile_cont(rate, 0.1), 6) AS p10, count(*) AS groups FROM ({_GR}) GROUP BY label", *BASE))
def _(spark, d):
    return rounded(G.macro_group_tail(V.scored(spark, d), T)[0])


@query("g4_worst_groups", with_views(f"SELECT label, place, group_id, round(rate, 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rate, group_id) AS place FROM ({_GR})) WHERE place <= 10", *BASE))
def _(spark, d):
    """A top-k report."""
    return rounded(G.macro_group_tail(V.scored(spark, d), T)[1])


@query("g5_macro_score", with_views(f"SELECT view, round(avg(x), 6) AS macro_score FROM (SELECT view, label, avg(rate) AS x FROM (SELECT view, label, group_id, avg({_OK}) AS rate FROM scored GROUP BY ALL) GROUP BY ALL) GROUP BY view", *BASE))
def _(spark, d):
    return rounded(G.macro_score(V.scored(spark, d), T, ("view",)))


_PAIR = "p AS (SELECT b.sample_id, b.label, s.view, b.probability AS p0, s.probability AS p1 FROM scored b JOIN scored s USING (sample_id) WHERE b.view = 'clean' AND s.view IN ('web', 'hard'))"


@query("g6_paired_stress", with_views(f""", {_PAIR}, x AS (SELECT view, count(*) AS n_pairs, avg(p1 - p0) AS md, avg(abs(p1 - p0)) AS ma, avg(((p0 >= {T}) <> (p1 >= {T}))::INT) AS fr,
        avg((p1 >= {T})::INT) FILTER (label = 1) - avg((p0 >= {T})::INT) FILTER (label = 1) AS dr, avg((p1 < {T})::INT) FILTER (label = 0) - avg((p0 < {T})::INT) FILTER (label = 0) AS ds FROM p GROUP BY view)
    SELECT view, n_pairs, round(md, 6) AS mean_delta, round(ma, 6) AS mean_abs_delta, round(fr, 6) AS flip_rate, round(dr, 6) AS delta_recall, round(ds, 6) AS delta_specificity, round((dr + ds) / 2, 6) AS delta_balanced_accuracy FROM x""", *BASE))
def _(spark, d):
    """G6 with J5."""
    return rounded(G.paired_stress(V.scored(spark, d), "clean", ["web", "hard"], T))


def paired(spark, d):
    from ..operators import joins as J

    return J.pair(V.scored(spark, d), V.scored(spark, d, "b", 0.8))


_PAIRED = "paired AS (SELECT a.sample_id, a.view, a.label, a.group_id, a.line, a.probability AS l, b.probability AS r FROM scored a JOIN scored_b b USING (sample_id, view))"
_OKL, _OKR = _OK.replace("probability", "l"), _OK.replace("probability", "r")


@query("g7_group_delta", with_views(f", {_PAIRED} SELECT group_id, min_by(label, line) AS label, count(*) AS n, round(avg({_OKL}), 6) AS left_rate, round(avg({_OKR}), 6) AS right_rate, round(avg({_OKR}) - avg({_OKL}), 6) AS delta FROM paired GROUP BY group_id", *BOTH))
def _(spark, d):
    """G7 with J4."""
    return rounded(G.group_delta(paired(spark, d), T))


def _side(c: str) -> str:
    return f"""(SELECT avg(({c} >= {T})::INT) FILTER (label = 1) AS recall, avg(({c} < {T})::INT) FILTER (label = 0) AS specificity, avg(({c} - label) ** 2) AS brier,
        (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM (SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rk FROM paired))"""


@query("g8_metric_delta", with_views(f""", {_PAIRED} SELECT round((y.recall + y.specificity - x.recall - x.specificity) / 2, 6) AS delta_balanced_accuracy, round(y.recall - x.recall, 6) AS delta_recall,
    round(y.specificity - x.specificity, 6) AS delta_specificity, round(y.auc - x.auc, 6) AS delta_auc, round(y.brier - x.brier, 6) AS delta_brier FROM {_side('l')} x, {_side('r')} y""", *BOTH))
def _(spark, d):
    return rounded(G.metric_delta(paired(spark, d), T))


_CASES = f"""c AS (SELECT *, max(probability) FILTER (view = 'clean') OVER (PARTITION BY sample_id) AS p0 FROM scored),
    cases AS (SELECT view, {CONFUSION}, avg(CASE WHEN label = 1 AND p0 >= {T} THEN (probability < {T})::INT END) AS hit, avg(probability - p0) AS md, avg(abs(probability - p0)) AS ma FROM c WHERE p0 IS NOT NULL GROUP BY view)"""


@query("g9_attack_cases", with_views(f", {_CASES} SELECT view, n, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')}, round(hit, 6) AS attack_success, round(md, 6) AS mean_delta, round(ma, 6) AS mean_abs_delta FROM cases", *BASE))
def _(spark, d):
    """G9 with J6."""
    return rounded(G.attack_cases(V.scored(spark, d), T).select("view", "n", "balanced_accuracy", "attack_success", "mean_delta", "mean_abs_delta"))


def family() -> F.Column:
    return F.when(F.col("view") == "clean", "none").otherwise("resize")


@query("g10_family_rollup", with_views(f""", {_CASES} SELECT CASE WHEN view = 'clean' THEN 'none' ELSE 'resize' END AS family, count(*) AS cases, round(min((tp / (tp + fn) + tn / (tn + fp)) / 2), 6) AS worst_balanced_accuracy,
    round(min(tp / (tp + fn)), 6) AS worst_recall, round(min(tn / (tn + fp)), 6) AS worst_specificity FROM cases GROUP BY ALL""", *BASE))
def _(spark, d):
    return rounded(G.family_rollup(G.attack_cases(V.scored(spark, d), T).withColumn("family", family())))


@query("g11_worst_variant", with_views("""SELECT sample_id, label, view, round(probability, 6) AS probability FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN label = 1 THEN probability ELSE -probability END, view_pos) AS k FROM scored) WHERE k = 1""", *BASE))
def _(spark, d):
    return rounded(G.worst_variant(V.scored(spark, d)))


@query("g12_attack_success", with_views(f""", s AS (SELECT sample_id, label, max(probability) FILTER (view = 'clean') AS p0, min(probability) FILTER (view <> 'clean') AS lo, max(probability) FILTER (view <> 'clean') AS hi FROM scored GROUP BY ALL),
    t AS (SELECT count(*) FILTER (label = 1 AND p0 >= {T}) AS clean_detected, count(*) FILTER (label = 1 AND p0 >= {T} AND lo < {T}) AS evaded, count(*) FILTER (label = 0 AND p0 < {T}) AS clean_passed, count(*) FILTER (label = 0 AND p0 < {T} AND hi >= {T}) AS false_positives FROM s)
    SELECT *, round(evaded / nullif(clean_detected, 0), 6) AS evasion_rate, round(false_positives / nullif(clean_passed, 0), 6) AS false_positive_rate FROM t""", *BASE))
def _(spark, d):
    return rounded(G.attack_success(V.scored(spark, d), T))


@query("g13_worst_case", with_views(f""", {_CASES}, m AS (SELECT view, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba, tp / (tp + fn) AS recall FROM cases WHERE view <> 'clean')
    SELECT (SELECT view FROM m ORDER BY ba, view LIMIT 1) AS worst_view, round(min(ba), 6) AS worst_balanced_accuracy, round(min(recall) FILTER (view = 'hard'), 6) AS critical_recall FROM m""", *BASE))
def _(spark, d):
    return rounded(G.worst_case(G.attack_cases(V.scored(spark, d), T), ["hard"]))


@query("g14_all_any", with_views(f"SELECT source, count(*) AS samples, round(avg(a::INT), 6) AS all_views, round(avg(o::INT), 6) AS any_view FROM (SELECT source, sample_id, bool_and({HIT}) AS a, bool_or({HIT}) AS o FROM scored GROUP BY ALL) GROUP BY source", *BASE))
def _(spark, d):
    return rounded(G.all_any_detected(V.scored(spark, d), T, ["source"]))


@query("g15_positive_summary", with_views(f""", s AS (SELECT source, view, count(*) AS n, count(*) FILTER ({HIT}) AS detected, avg(probability) AS m, stddev_pop(probability) AS sd, min(probability) AS lo, max(probability) AS hi,
        quantile_cont(probability, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM scored WHERE label = 1 GROUP BY ALL),
    w AS (SELECT *, detected / n AS k, 1 + {S.Z95 ** 2} / n AS dd FROM s), h AS (SELECT *, (k + {S.Z95 ** 2 / 2} / n) / dd AS mid, {S.Z95} * sqrt(k * (1 - k) / n + {S.Z95 ** 2 / 4} / (n * n)) / dd AS half FROM w)
    SELECT source, view, n, detected, round(m, 6) AS mean_p, round(sd, 6) AS std_p, round(lo, 6) AS min_p, round(hi, 6) AS max_p, round(k, 6) AS recall, round(greatest(0, mid - half), 6) AS recall_low, round(least(1, mid + half), 6) AS recall_high,
           round(q[1], 6) AS p05, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p95 FROM h""", *BASE))
def _(spark, d):
    """G15 with P25."""
    return rounded(G.positive_summary(V.scored(spark, d).where("label = 1"), ["source", "view"], T))


@query("g16_transitions", with_views(f", {_PAIR} SELECT view, count(*) FILTER (p0 >= {T} AND p1 < {T}) AS detected_to_missed, count(*) FILTER (p0 < {T} AND p1 >= {T}) AS missed_to_detected, round(avg(p1 - p0), 6) AS mean_delta, round(median(p1 - p0), 6) AS median_delta FROM p GROUP BY view", *BASE))
def _(spark, d):
    return rounded(G.transitions(V.scored(spark, d), "clean", ["web", "hard"], T))


@query("g17_ledger_parity", with_views(f""", j AS (SELECT a.raw_logit AS x, b.raw_logit AS y, (1 / (1 + exp(-(a.raw_logit + 0.6))) >= {T}) <> (1 / (1 + exp(-(b.raw_logit + 0.6))) >= {T}) AS diff FROM scored a JOIN scored_b b USING (sample_id, view))
    SELECT count(*) AS n, round(max(abs(x - y)), 6) AS max_delta, round(avg(abs(x - y)), 6) AS mean_delta, count(*) FILTER (diff) AS disagreements, round(avg(diff::INT), 6) AS disagreement_rate FROM j""", *BOTH))
def _(spark, d):
    return rounded(G.ledger_parity(V.scored(spark, d), V.scored(spark, d, "b", 0.8), 1.0, 0.6, T))


@query("g18_macro_views", with_views(f""", m AS (SELECT view, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, auc FROM (SELECT view, {CONFUSION} FROM scored GROUP BY view) JOIN ({auc_sql('scored', 'view')}) USING (view) WHERE view <> 'clean')
    SELECT count(*) AS views, round(avg((recall + specificity) / 2), 6) AS macro_balanced_accuracy, round(avg(recall), 6) AS macro_recall, round(avg(specificity), 6) AS macro_specificity, round(avg(auc), 6) AS macro_auc FROM m""", *BASE))
def _(spark, d):
    return rounded(G.macro_views(M.view_metrics(V.scored(spark, d), T), F.col("view") != "clean"))


@query("g19_role_summary", with_views("""SELECT role, coalesce(n, 0) AS n, coalesce(r, 0) AS real, coalesce(f, 0) AS fake, coalesce(g, 0) AS groups FROM (VALUES ('train'), ('calibration'), ('test')) t(role) LEFT JOIN (
    SELECT role, count(*) AS n, count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS f, count(DISTINCT group_id) AS g FROM manifest GROUP BY role) USING (role)""", "manifest"))
def _(spark, d):
    return G.role_summary(V.manifest(spark, d), V.ROLES)


@query("g20_composition", with_views("SELECT role, label, source, count(*) AS n FROM manifest GROUP BY ROLLUP (role, label, source)", "manifest"))
def _(spark, d):
    return G.composition(V.manifest(spark, d), ["role", "label", "source"], rollup=True)


@query("g21_standardized_difference", with_views(""", f AS (SELECT label, 'log_width' AS feature, ln(greatest(width, 1)) AS x FROM manifest UNION ALL SELECT label, 'log_height', ln(greatest(height, 1)) FROM manifest UNION ALL SELECT label, 'log_bytes', ln(1 + n_bytes) FROM manifest
    UNION ALL SELECT label, 'bytes_per_pixel', n_bytes / (greatest(width, 1)::DOUBLE * greatest(height, 1)) FROM manifest)
    SELECT feature, round(CASE WHEN stddev_pop(x) > 1e-12 THEN (avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0)) / stddev_pop(x) ELSE 0 END, 6) AS difference FROM f GROUP BY feature""", "manifest"))
def _(spark, d):
    """G21 with P9."""
    none = F.lit(None).cast("string")
    m = V.manifest(spark, d)
    f = m.select("label", *S.metadata_features(F.col("width"), F.col("height"), F.col("n_bytes"), none, none))
    return rounded(G.standardized_difference(f, ["log_width", "log_height", "log_bytes", "bytes_per_pixel"]))


_CURVES = "curves AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY day) AS step, loss, g AS gradient_norm FROM (SELECT user_id, CAST(ts AS DATE) AS day, round(avg(value), 9) AS loss, max(value) AS g FROM events GROUP BY ALL))"


def curves(spark, d):
    """A run's mean value of each day, to nine decimals: a mean's last bits hang on the order of its sum, and bounds may lie on a mean."""
    from pyspark.sql import Window

    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("run_id"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("loss"), F.max("value").alias("gradient_norm"))
    return e.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("day")))


def canary(spark, d):
    """(curves, validations, runs) of the runs with enough points: every second point is a validation, too."""
    c = curves(spark, d)
    c = c.join(c.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").select("run_id"), "run_id")
    runs = c.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps")).withColumns({"samples": F.col("steps") * 48, "decode_failures": F.when(F.col("run_id") % 5 == 0, 1).otherwise(0), "eligible": F.col("run_id") % 3 != 0})
    return c, c.where("step % 2 = 0").select("run_id", "step", (1 / (1 + F.col("loss") / 100)).alias("macro_score")), runs


_HEALTH = f"""{_CURVES}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY gradient_norm, step) AS g FROM curves),
    t AS (SELECT *, median(loss) FILTER (k > n // 2) OVER (PARTITION BY run_id) AS mid FROM r WHERE n >= 6),
    s AS (SELECT run_id, max(n) AS points, median(loss) FILTER (k <= 3) AS first_loss, median(loss) FILTER (k > n - 3) AS last_loss, regr_slope(loss, step) * 100 AS slope_100, median(abs(loss - mid)) FILTER (k > n // 2) AS tail_mad,
        max(gradient_norm) FILTER (g = round_even((n - 1) * 0.95, 0) + 1) AS gradient_p95, max(gradient_norm) AS gradient_max, bool_and(isfinite(loss) AND isfinite(gradient_norm)) AS finite,
        arg_min(1 / (1 + loss / 100), step) FILTER (step % 2 = 0) AS first_score, arg_max(1 / (1 + loss / 100), step) FILTER (step % 2 = 0) AS last_score, max(1 / (1 + loss / 100)) FILTER (step % 2 = 0) AS best_score FROM t GROUP BY run_id),
    h AS (SELECT *, run_id % 5 <> 0 AS no_decode_failures, last_loss <= first_loss * 1.1::DOUBLE AS loss_not_worse, gradient_p95 < 100 AS gradient_bounded, last_score >= first_score - 0.01::DOUBLE AS validation_not_worse FROM s),
    health AS (SELECT *, finite AND no_decode_failures AND loss_not_worse AND gradient_bounded AND validation_not_worse AS healthy FROM h)"""
_HEALTH_COLUMNS = ("first_loss", "last_loss", "tail_mad", "gradient_p95", "gradient_max", "first_score", "last_score", "best_score")


@query("g25_curve_health", f"""WITH {_HEALTH} SELECT run_id, points, {', '.join(r(c, c) for c in _HEALTH_COLUMNS)}, round(slope_100, 4) AS slope_100, round((first_loss - last_loss) / greatest(first_loss, 1e-12), 6) AS loss_reduction,
    finite, no_decode_failures, loss_not_worse, gradient_bounded, validation_not_worse, healthy FROM health""")
def _(spark, d):
    return rounded(G.curve_health(*canary(spark, d)).withColumn("slope_100", F.round("slope_100", 4)).select("run_id", "points", *_HEALTH_COLUMNS, "slope_100", "loss_reduction", *G.CHECKS, "healthy"))


@query("g26_stable_count", f"WITH {_CURVES} SELECT count(*) FILTER (step > 0 AND loss >= 50 + 0.005) AS stable FROM curves")
def _(spark, d):
    return G.stable_count(curves(spark, d).withColumn("score", F.col("loss")), 50.0)
