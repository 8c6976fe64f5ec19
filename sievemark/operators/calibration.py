"""Calibrators: identity, bias and Platt, fitted for all groups or all folds at once, and chosen by leave-one-group-out.

A fit needs the counts of each score by class and fold, in the order of scores. Of these `cells` one pass gives the best thresholds of all folds, and one pass a Newton step
of all of them: a fold's sums are arrays over folds in which each row adds to every fold but its own, so no row is copied for a fold and no fold has a job. Fits and scores come back as small local tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import written
from .ordered import PART, in_parts
from .sampling import logo_folds

METHODS = ("identity", "bias", "platt")
RIDGE = (1e-4, 1e-8)
STEPS, CLOSE = 100, 1e-8
BLOCK = 1_000_000
"""Rows by fits that a task works on at once."""


@dataclass
class Gang:
    """The fits of one model: those of its folds, each without its own fold's rows, and a last one of all rows. Or one fit for each group, of its own rows."""

    pos: np.ndarray
    neg: np.ndarray
    others: bool = True

    @classmethod
    def of(cls, pos: np.ndarray, neg: np.ndarray, others: bool) -> Gang:
        """From the rows of each fold and class."""
        if not others:
            return cls(pos, neg, False)
        return cls(np.append(pos.sum() - pos, pos.sum()), np.append(neg.sum() - neg, neg.sum()))

    def __len__(self) -> int:
        return len(self.pos)

    def used(self, fold: np.ndarray) -> np.ndarray:
        """Rows by fits: whether the fit uses rows of the fold."""
        own = fold[:, None] == np.arange(len(self))
        return ~own if self.others else own


def local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table in the plan itself, which costs no job to make or read."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return spark.createDataFrame(pa.table({n: [r[n] for r in rows] for n in names}) if rows else [], schema)


def cells_of(rows: DataFrame, by: str, extra: list[str] = ()) -> DataFrame:
    """(by, raw_logit, fold, label, *extra, n), in parts of the order of scores: equal rows are counted before they are ordered."""
    return in_parts(rows.groupBy(by, "raw_logit", "fold", "label", *extra).agg(F.count(F.lit(1)).alias("n")), [by, "raw_logit"], "cells")


def _models(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    d = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    at = d.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(d.dictionary.to_pylist()):
        yield name, np.flatnonzero(at == k)


def _thresholds(gangs: dict, starts: dict, by: str):
    """Of each part and fit: the best threshold among the part's scores, the least and the highest score, and the part's share of the AUC's area."""

    def run(table: pa.Table) -> pa.Table:
        part, out = table.column(PART)[0].as_py(), []
        for name, at in _models(table.column(by)):
            g, (pos, neg) = gangs[name], (a.copy() for a in starts[name][part])
            x, fold, label, n = (table.column(c).to_numpy()[at] for c in ("raw_logit", "fold", "label", "n"))
            scores, inverse = np.unique(x, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            inverse, fold, label, n = inverse[order], fold[order], label[order], n[order]
            safe = 2 * int(g.pos.max(initial=0)) * int(g.neg.max(initial=0)) < 2**63
            P, N = (a.astype(np.int64 if safe else object) for a in (g.pos, g.neg))
            best, area = [(None, np.inf, np.inf)] * len(g), np.zeros(len(g))
            lo, hi = np.full(len(g), np.inf), np.full(len(g), -np.inf)
            step = max(1, BLOCK // len(g))
            for f in range(0, len(scores), step):
                s = scores[f : f + step]
                a, b = np.searchsorted(inverse, [f, f + len(s)])
                here = []
                for k in (1, 0):
                    of = np.zeros((len(s), len(g)), np.int64)
                    i = np.flatnonzero(label[a:b] == k) + a
                    for c in range(0, len(i), step):
                        j = i[c : c + step]
                        np.add.at(of, inverse[j] - f, n[j][:, None] * g.used(fold[j]))
                    here.append(of)
                low = [start + np.cumsum(of, axis=0) - of for start, of in zip((pos, neg), here)]
                some = here[0] + here[1] > 0
                area += (here[0] * (low[1] + here[1] / 2)).sum(axis=0)
                goal = (P - low[0]) * N + low[1] * P
                goal = np.where(some, goal, -1)
                for m in range(len(g)):
                    top = goal[:, m].max()
                    if top >= 0:
                        ties = s[goal[:, m] == top]
                        t = float(ties[np.lexsort((ties, np.abs(ties)))[0]])
                        if best[m][0] is None or (-top, abs(t), t) < (-best[m][0], best[m][1], best[m][2]):
                            best[m] = (int(top), abs(t), t)
                        used = s[some[:, m]]
                        lo[m], hi[m] = min(lo[m], used[0]), max(hi[m], used[-1])
                pos, neg = pos + here[0].sum(axis=0), neg + here[1].sum(axis=0)
            out += [(name, m, g0, t, float(lo[m]), float(hi[m]), float(area[m])) for m, (g0, _, t) in enumerate(best) if g0 is not None]
        cols = list(zip(*out)) or [()] * 7
        from decimal import Decimal

        goal = pa.array([Decimal(v) for v in cols[2]], pa.decimal128(38, 0))
        return pa.table([pa.array(cols[0], table.column(by).type), pa.array(cols[1], pa.int32()), goal, *[pa.array(c, pa.float64()) for c in cols[3:]]], names=[by, "fit", "goal", "t", "lo", "hi", "area"])

    return run


def _sums(gangs: dict, at: dict, by: str):
    """The five sums of a Newton step of every fit, as one array for each task."""
    first, total = {}, 0
    for name, g in gangs.items():
        first[name], total = total, total + len(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((total, 5))
        for batch in batches:
            for name, rows in _models(batch.column(by)):
                g, (a, b) = gangs[name], at[name].T
                sizes = g.pos + g.neg
                weight = {1: sizes / (2.0 * np.maximum(g.pos, 1)), 0: sizes / (2.0 * np.maximum(g.neg, 1))}
                for f in range(0, len(rows), step := max(1, BLOCK // len(g))):
                    x, fold, label, n = (batch.column(c).to_numpy()[rows[f : f + step]] for c in ("raw_logit", "fold", "label", "n"))
                    w = np.where(label[:, None] == 1, weight[1], weight[0]) * g.used(fold) * n[:, None]
                    p = (1 + np.tanh((x[:, None] * a + b) / 2)) / 2
                    d, h = w * (p - label[:, None]), w * p * (1 - p)
                    out[first[name] : first[name] + len(g)] += np.stack([x @ d, d.sum(axis=0), (x * x) @ h, x @ h, h.sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], names=["s"])

    return run, first, total


def _slopes(cells: DataFrame, gangs: dict, by: str) -> dict:
    """Logistic slopes, classes weighed equally: within [1e-3, 100], 1 where they can't be solved. One job for a step of all fits."""
    at = {m: np.tile([1.0, 0.0], (len(g), 1)) for m, g in gangs.items()}
    out = {m: np.ones(len(g)) for m, g in gangs.items()}
    live = {m: (g.pos > 0) & (g.neg > 0) for m, g in gangs.items()}
    slim = cells.select(by, "raw_logit", "fold", "label", "n")
    for _ in range(STEPS):
        if not any(x.any() for x in live.values()):
            break
        run, first, total = _sums(gangs, at, by)
        sums = np.zeros(total * 5)
        for i, x in slim.mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col")).collect():
            sums[i] = x
        sums = sums.reshape(total, 5)
        for m in gangs:
            for k in np.flatnonzero(live[m]):
                gx, g0, hxx, hx, h0 = sums[first[m] + k]
                beta = at[m][k]
                try:
                    step = np.linalg.solve([[hxx + RIDGE[0], hx], [hx, h0 + RIDGE[1]]], [gx + RIDGE[0] * beta[0], g0 + RIDGE[1] * beta[1]])
                except np.linalg.LinAlgError:
                    live[m][k], out[m][k] = False, 1.0
                    continue
                at[m][k] = beta - step
                out[m][k] = np.clip(at[m][k][0], 1e-3, 100) if np.isfinite(at[m][k][0]) else 1.0
                if not np.linalg.norm(step) >= CLOSE:
                    live[m][k] = False
    return out


def _best(cells: DataFrame, gangs: dict, starts: dict, by: str) -> tuple[dict, dict]:
    """(thresholds of each fit, AUC of each model over all rows). What lies just outside the scores competes as a threshold of balanced accuracy 0.5."""
    names = [by, "raw_logit", "fold", "label", "n", PART]
    kind = cells.schema[by].dataType.simpleString()
    found = cells.select(*names).groupBy(PART).applyInArrow(_thresholds(gangs, starts, by), f"{by} {kind}, fit int, goal decimal(38,0), t double, lo double, hi double, area double")
    per = found.groupBy(by, "fit").agg(F.min(F.struct((-F.col("goal")).alias("g"), F.abs("t").alias("a"), "t")).alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("area").alias("area"))
    best, auc = {m: np.full(len(g), np.nan) for m, g in gangs.items()}, {}
    for r in per.collect():
        g, m = gangs[r[by]], r["fit"]
        P, N = int(g.pos[m]), int(g.neg[m])
        choices = [(int(r["b"]["g"]), r["b"]["a"], r["b"]["t"])] + [(-P * N, abs(t), t) for t in (float(np.nextafter(r["lo"], -np.inf)), float(np.nextafter(r["hi"], np.inf)))]
        best[r[by]][m] = min(choices)[2]
        if m == len(g) - 1:
            auc[r[by]] = r["area"] / (P * N) if P and N else None
    return best, auc


def _gangs(cells: DataFrame, by: str, others: bool) -> tuple[dict, dict]:
    """(gangs, the rows below each part by fit and class): from the counts of each part, fold and class."""
    rows = cells.groupBy(by, PART, "fold").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("q")).collect()
    gangs, starts = {}, {}
    parts = sorted({r[PART] for r in rows})
    place = {p: i for i, p in enumerate(parts)}
    for name in {r[by] for r in rows}:
        own = [r for r in rows if r[by] == name]
        k = max(r["fold"] for r in own) + 1
        table = np.zeros((2, len(parts), k), np.int64)
        for r in own:
            table[0, place[r[PART]], r["fold"]] += r["p"]
            table[1, place[r[PART]], r["fold"]] += r["q"]
        gangs[name] = Gang.of(table[0].sum(axis=0), table[1].sum(axis=0), others)
        low = np.cumsum(table, axis=1) - table
        low = np.concatenate([low.sum(axis=2, keepdims=True) - low, low.sum(axis=2, keepdims=True)], axis=2) if others else low
        starts[name] = {p: (low[0, i], low[1, i]) for p, i in place.items()}
    return gangs, starts


def platt_slopes(df: DataFrame, by: str) -> dict:
    """Logistic slope of raw_logit for each value of `by`."""
    cells = cells_of(df.withColumn("fold", F.lit(0)), by)
    gangs, _ = _gangs(cells, by, False)
    return {m: float(x[0]) for m, x in _slopes(cells, gangs, by).items()}


def _fit(method: str, target: float, boundary: float, slope: float) -> tuple[float, float, float]:
    """(slope, intercept, boundary): the boundary maps to the target exactly; identity has slope 1 and intercept 0."""
    logit = float(np.log(target / (1 - target)))
    if method == "identity":
        return 1.0, 0.0, logit
    slope = slope if method == "platt" else 1.0
    return slope, logit - slope * boundary, boundary


def fit_calibrators(df: DataFrame, methods: tuple[str, ...], target: float, by: str) -> DataFrame:
    """(by, method, slope, intercept, boundary) of each group, on the group's own rows."""
    cells = cells_of(df.withColumn("fold", F.lit(0)), by)
    gangs, starts = _gangs(cells, by, False)
    best, _ = _best(cells, gangs, starts, by)
    slopes = _slopes(cells, gangs, by) if "platt" in methods else {m: np.ones(1) for m in gangs}
    rows = [dict(zip(("slope", "intercept", "boundary"), _fit(method, target, float(best[m][0]), float(slopes[m][0])))) | {by: m, "method": method} for m in gangs for method in methods]
    return local(df.sparkSession, rows, f"{by} {df.schema[by].dataType.simpleString()}, method string, slope double, intercept double, boundary double")


SCORES = "method string, macro_score double, balanced_accuracy double, brier double, log_loss double"
FIT = "method string, slope double, intercept double, boundary double"
SIMPLE = ("identity", "bias", "platt")


def select_calibrators(df: DataFrame, by: str, target: float, methods: tuple[str, ...] = METHODS) -> dict:
    """For each value of `by`: {scores: [...], final: {...}, auc}. Every method scores each fold by a fit on all other rows; the best macro score wins, then the lowest log loss, then the simplest
    method, and is fitted on all rows. Needs three positive groups and both classes outside of each fold. auc is that of the raw scores."""
    spark = df.sparkSession
    rows = written(df.select(by, "sample_id", "group_id", "label", "raw_logit"), "fit-rows")
    cells = cells_of(logo_folds(rows, [by]), by, ["group_id"])
    gangs, starts = _gangs(cells, by, True)
    for name, g in gangs.items():
        positive = (g.pos[:-1] < g.pos[-1]).sum()
        if positive < 3:
            raise ValueError(f"three positive groups are needed, {name} has {positive}")
        if not (g.pos.all() and g.neg.all()):
            raise ValueError(f"{name}: a fold leaves one class only")
    best, auc = _best(cells, gangs, starts, by)
    slopes = _slopes(cells, gangs, by) if "platt" in methods else {m: np.ones(len(g)) for m, g in gangs.items()}
    fits = [{by: m, "fold": k, "fits": [dict(zip(("method", "slope", "intercept"), (x, *_fit(x, target, float(best[m][k]), float(slopes[m][k]))[:2]))) for x in methods]} for m, g in gangs.items() for k in range(len(g) - 1)]
    fits = local(spark, fits, f"{by} {df.schema[by].dataType.simpleString()}, fold int, fits array<struct<method: string, slope: double, intercept: double>>")
    out = cells.join(F.broadcast(fits), [by, "fold"]).select("*", F.inline("fits")).withColumn("p", S.calibrate(F.col("raw_logit"), F.col("slope"), F.col("intercept")))  # a row per fold
    n = F.col("n")
    per = out.groupBy(by, "method", "label", "group_id").agg(
        F.sum("n").alias("n"), F.sum(S.correct(F.col("label"), F.col("p"), target).cast("long") * n).alias("ok"), F.sum((F.col("p") - F.col("label")) ** 2 * n).alias("brier"), F.sum(S.log_loss_row(F.col("label"), F.col("p")) * n).alias("loss"),
    )
    sums = per.groupBy(by, "method", "label").agg(F.avg(F.col("ok") / F.col("n")).alias("macro"), *[F.sum(c).alias(c) for c in ("n", "ok", "brier", "loss")])
    sums = sums.groupBy(by, "method").agg(F.avg("macro").alias("macro_score"), F.avg(F.col("ok") / F.col("n")).alias("balanced_accuracy"), (F.sum("brier") / F.sum("n")).alias("brier"), (F.sum("loss") / F.sum("n")).alias("log_loss"))
    found = {}
    for r in sums.collect():  # a row per model and method
        found.setdefault(r[by], []).append(r.asDict())
    result = {}
    for m, scores in found.items():
        # Methods of one boundary decide alike; the order in which rates are summed must not part them.
        first = min(scores, key=lambda r: (-round(r["macro_score"], 12), round(r["log_loss"], 12), SIMPLE.index(r["method"])))["method"]
        final = dict(zip(("slope", "intercept", "boundary"), _fit(first, target, float(best[m][-1]), float(slopes[m][-1]))))
        result[m] = {"scores": scores, "final": {"method": first, **final}, "auc": auc[m]}
    return result


def select_calibrator(df: DataFrame, target: float, methods: tuple[str, ...] = METHODS) -> tuple[DataFrame, DataFrame]:
    """(scores per method, the chosen method fitted on all rows), as local tables."""
    found = next(iter(select_calibrators(df.withColumn("_model", F.lit("")), "_model", target, methods).values()), None)
    if found is None:
        raise ValueError("three positive groups are needed, there are no rows")
    return local(df.sparkSession, found["scores"], SCORES), local(df.sparkSession, [found["final"]], FIT)


def apply_calibrator(df: DataFrame, calibrator: DataFrame, target: float) -> DataFrame:
    """df with probability; calibrator has one row (slope, intercept, boundary). Fails where p >= target and logit >= boundary disagree by more than rounding."""
    c = calibrator.select(F.col("slope").alias("_s"), F.col("intercept").alias("_i"), F.col("boundary").alias("_t"))
    p = S.calibrate(F.col("raw_logit"), F.col("_s"), F.col("_i"))
    rows = df.crossJoin(F.broadcast(c)).withColumn("probability", p)  # one row
    odd = ((F.col("probability") >= target) != (F.col("raw_logit") >= F.col("_t"))) & (F.abs(F.col("probability") - target) > 1e-9)
    return rows.withColumn("probability", F.when(odd, F.raise_error(F.lit("calibrator disagrees with its boundary")).cast("double")).otherwise(F.col("probability"))).drop("_s", "_i", "_t")
