"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares two short strings by all their subsequences of three letters, each weighed by DECAY to the power of the
stretch it spans, so a gap or an inserted letter lowers the likeness a little instead of ending it. Strings are the letters of one
white-space token, punctuation left out (`i.d.i-o.t`), its beginnings of STEMS letters, and runs of single letters (`i d i o t`).

Training sees labelled sentences: a bounded sample of SAMPLE documents of each label. Which string of a toxic document makes it
toxic isn't labelled. Each string's documents of both labels are tested for a difference, at a share FDR of false discoveries; of those
that pass, a greedy cover takes all that explain toxic documents beyond ten times their chance hits, and these strings
are the positive ones, however few documents hold them. Strings of clean documents are negative; in each of ROUNDS rounds but the last, those that score
highest are added. Landmarks are all covering strings, the strongest other candidates, and in each round as many of the clean strings mistaken for them. The trained machine is linear in landmark
kernels; folded into one weight for each letter triple it scores a string exactly, without a landmark at hand.

A document's decision value is that of its highest string, at least -1 (the machine's negative margin); a logistic fit on the
sample turns it into a score. lang, source and ids are never inputs.

Defined results: null and empty texts, and texts without a string of three letters, get the lowest score; ids that are labelled
several times count as toxic if any label says so, null labels are no labels; without labels of both kinds every score is 0;
repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of, written

SAMPLE = 3000
"""Labelled documents of each label that training takes, about: those with the lowest hashes."""
CANDIDATES, LANDMARKS, NEGATIVES, HARD = 400, 64, 4000, 400
ROUNDS = 6
FDR, LEAST = 0.05, 1.5
"""Share of false discoveries among the strings that pass the test, and the documents that a string of the cover explains beyond chance hits, at any size of the sample."""
DECAY, ORDER, LONGEST, STRIDE = 0.6, 3, 16, 8
STEMS = range(4, 8)
ACCENTED = "äöüßéèêàçñóíáúâîôûëï"
OTHERS = 16
LETTERS = 26 + len(ACCENTED) + OTHERS + 1
"""a to z, the accented, OTHERS symbols that letters beyond Latin-1 share by code point, and one for every other letter or digit."""
FLOOR = -1.0
CACHE_CHARS = 1_500_000
"""Characters of the tokens whose value a worker remembers; beyond it the memory is emptied. It changes speed only."""

DROP, SEP = 255, 254
codecs.register_error("sievemark_other", lambda e: ("".join(chr(128 + ord(c) % OTHERS) if c.isalnum() else " " for c in e.object[e.start : e.end]), e.end))
_CODE = np.full(256, DROP, np.uint8)
_CODE[[i for i in range(128, 256) if chr(i).isalnum()] + list(range(48, 58))] = LETTERS - 1
_CODE[97:123] = np.arange(26)
_CODE[[ord(c) for c in ACCENTED]] = np.arange(26, 26 + len(ACCENTED))
_CODE[128 : 128 + OTHERS] = np.arange(26 + len(ACCENTED), LETTERS - 1)
_CODE[10] = SEP
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")


def codes_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all strings in one array, and each string's start and length there. Strings hold no line feeds."""
    raw = _CODE[np.frombuffer(("\n".join(strings) + "\n").encode("latin-1", "sievemark_other"), np.uint8)]
    raw = raw[raw != DROP]
    ends = np.flatnonzero(raw == SEP)
    starts = np.r_[0, ends[:-1] + 1]
    return raw, starts, ends - starts


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(itertools.combinations(range(n), ORDER)))
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


_TRIPLES = {n: _triples(n) for n in range(ORDER, LONGEST + 1)}


def _cells(letters: np.ndarray) -> np.ndarray:
    at, _ = _TRIPLES[letters.shape[1]]
    x = letters.astype(np.int32)
    return x[:, at[:, 0]] * np.int32(LETTERS * LETTERS) + x[:, at[:, 1]] * np.int32(LETTERS) + x[:, at[:, 2]]


def norms(cells: np.ndarray, n: int) -> np.ndarray:
    """Length of the feature vector of each row: a triple that occurs more than once adds up before it is squared."""
    w = _TRIPLES[n][1]
    order = np.argsort(cells, axis=1, kind="stable")
    cells, upto = np.take_along_axis(cells, order, 1), np.cumsum(w[order], axis=1)
    last = np.ones(cells.shape, bool)
    last[:, :-1] = cells[:, 1:] != cells[:, :-1]
    ends = np.where(last, upto, 0)
    before = np.zeros_like(upto)
    before[:, 1:] = np.maximum.accumulate(ends, axis=1)[:, :-1]
    return np.sqrt(np.where(last, (upto - before) ** 2, 0).sum(1))


def window_starts(n: int) -> list[int]:
    """Where the windows of a string of n letters start: one, if it has LONGEST at most."""
    return sorted({*range(0, n - LONGEST, STRIDE), max(0, n - LONGEST)})


def by_length(strings: list[str], stems: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, index of the string, letters): windows of at most LONGEST letters, and stems, grouped by length."""
    if not strings:
        return
    raw, starts, lens = codes_of(strings)
    index = np.arange(len(strings))
    long = lens > LONGEST
    if long.any():
        parts = [(i, s + k) for i, s, n in zip(index[long], starts[long], lens[long]) for k in window_starts(n)]
        index = np.r_[index[~long], [i for i, _ in parts]].astype(np.int64)
        starts = np.r_[starts[~long], [s for _, s in parts]].astype(np.int64)
        lens = np.r_[lens[~long], np.full(len(parts), LONGEST)]
    for n in STEMS if stems else ():
        own = lens > n
        index, starts, lens = np.r_[index, index[: len(own)][own]], np.r_[starts, starts[: len(own)][own]], np.r_[lens, np.full(own.sum(), n)]
    for n in range(ORDER, LONGEST + 1):
        if len(own := np.flatnonzero(lens == n)):
            for at in range(0, len(own), 4096):
                x = own[at : at + 4096]
                yield n, index[x], raw[starts[x][:, None] + np.arange(n)]


def features(strings: list[str], cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised feature vectors, one row per string of at most LONGEST letters, and the triples of the columns: those
    given, in order, or all that occur."""
    parts = []
    for n, index, letters in by_length(strings, False):
        own, w = _cells(letters), _TRIPLES[n][1]
        parts.append((np.repeat(index, own.shape[1]), own.ravel(), (w[None] / norms(own, n)[:, None]).ravel()))
    row, cell, value = (np.concatenate(x) for x in zip(*parts))
    cells = np.unique(cell) if cells is None else cells
    at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    hit = cells[at] == cell
    out = np.zeros((len(strings), len(cells)), np.float32)
    np.add.at(out, (row[hit], at[hit]), value[hit])
    return out, cells


class Machine:
    """Decision values of strings from one weight per letter triple; remembers tokens."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known, self.chars = weights.astype(np.float32), float(bias), {}, 0
        self.least = {n: float(np.sqrt((w**2).sum())) for n, (_, w) in _TRIPLES.items()}

    def values(self, strings: list[str]) -> np.ndarray:
        """At least FLOOR each. Where even the smallest possible norm leaves a value under FLOOR, the norm isn't needed."""
        out = np.full(len(strings), FLOOR, np.float32)
        for n, index, letters in by_length(strings, True):
            cells = _cells(letters)
            dots = self.weights[cells] @ _TRIPLES[n][1]
            near = np.flatnonzero(dots > (FLOOR - self.bias) * self.least[n] if FLOOR > self.bias else np.ones(len(dots), bool))
            if len(near):
                np.maximum.at(out, index[near], dots[near] / norms(cells[near], n) + self.bias)
        return out

    def learn(self, sets: list[set[str]]) -> None:
        """Values of all tokens of these sets."""
        if self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        tokens = list(set().union(*sets).difference(self.known))
        self.chars += sum(map(len, tokens))
        self.known.update(zip(tokens, self.values(tokens).tolist()))


def single_runs(text: str) -> list[str]:
    """Runs of at least three single characters with white space between, joined."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    blank = raw <= 32
    one = ~blank[1:-1] & blank[:-2] & blank[2:]
    if len(one) < 4 or not (one[:-2] & one[2:]).any():
        return []
    return ["".join(x.split()) for x in SINGLES.findall(text)]


def strings_of(text: str) -> set[str]:
    text = text.lower()
    return {*text.split(), *single_runs(text)}


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def sample_rows(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic) of about `size` training documents of each label, fewer where there are fewer."""
    l = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in l.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return docs.limit(0).select(text_of().alias("text"), F.lit(0).alias("toxic"))
    rank = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    keep = F.when(F.col("toxic") == 1, rank < size / counts[1]).otherwise(rank < size / counts[0])
    return (
        docs.select(F.col("doc_id").alias("id"), text_of().alias("text"))
        .join(F.broadcast(l.where(keep).select(F.col("doc_id").alias("id"), "toxic")), "id")  # about 2 * size rows
        .groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            clean = {re.sub(r"[\W_]+", "", s) for s in strings_of(text)}
            clean = {s[k : k + LONGEST] for s in clean for k in window_starts(len(s))}
            clean |= {s[:n] for s in clean for n in STEMS}
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic], pa.int32()), "strings": pa.array([sorted(s for s in clean if len(s) >= ORDER)], pa.list_(pa.string()))})


def variants(word: str) -> list[str]:
    """The word with one letter put in at each inner place, doubled, or left out."""
    put = [word[:i] + c + word[i:] for i in range(1, len(word)) for c in ("a", "x", "1", word[i - 1])]
    return put + [word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)]


def fit_svm(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Weights and bias of an SVM with squared hinge loss and costs c, by Newton steps in the primal."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):
        on = y * (x @ w) < 1
        a = x[on] * c[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        step, w = np.abs(new - w).max(), w + (new - w) * (0.5 if _ > 25 else 1)
        if step < 1e-7:
            break
    return w


def contrast(pos: int, neg: int, share: float) -> float:
    """Log-likelihood ratio of pos toxic and neg clean documents against a share of toxic ones; 0 where there are not more toxic ones than that.
    By Chernoff's bound, chance reaches it with a probability of at most exp(-contrast); exactly that where neg is 0."""
    k = pos + neg
    if pos <= share * k:
        return 0.0
    return pos * np.log(pos / (share * k)) + (neg * np.log(neg / ((1 - share) * k)) if neg else 0.0)


def discoveries(counts: list[tuple[int, int, int]], share: float) -> list[tuple[int, int]]:
    """The (pos, neg) that pass, of (pos, neg, strings): Benjamini and Hochberg's rule, with a rate of FDR."""
    ranked = sorted(((contrast(p, n, share), p, n, k) for p, n, k in counts), reverse=True)
    upto = np.cumsum([k for *_, k in ranked])
    passed = [i for i, (g, *_) in enumerate(ranked) if g > 0 and np.exp(-g) <= FDR * upto[i] / upto[-1]]
    return [(p, n) for _, p, n, _ in ranked[: passed[-1] + 1]] if passed else []


def cover(docs: list[list[str]], rates: dict[str, float], least: float) -> list[str]:
    """Strings that explain toxic documents, greedily: a document counts half as much with each string it holds of those
    found so far, as insults come together. rates: how often each string occurs in clean documents."""
    weight, out = [1.0] * len(docs), []
    while True:
        gain: dict[str, float] = {}
        for d, w in zip(docs, weight):
            for s in d:
                gain[s] = gain.get(s, 0) + w
        fair = {s: g - 10 * rates[s] * len(docs) for s, g in gain.items() if not any(s.startswith(o) or o.startswith(s) for o in out)}
        best = max(fair, key=lambda s: (fair[s], s), default=None)
        if best is None or fair[best] < least:
            break
        out.append(best)
        weight = [w / 2 if best in d else w for d, w in zip(docs, weight)]
    return out


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> dict | None:
    """weights, bias, slope, offset; None without labels of both kinds. What comes to the driver is bounded by SAMPLE, CANDIDATES, NEGATIVES and HARD:
    the strings that pass the test are strings of the sample."""
    rows = written(sample_rows(docs, labels, size), "toxic-sample")
    bags = written(rows.mapInArrow(_strings, "toxic int, strings array<string>"), "toxic-strings")
    n = {r[0]: r[1] for r in bags.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    stats = written(bags.select("toxic", F.explode("strings").alias("s")).groupBy("s").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "toxic-stats")
    lift = F.col("pos") * F.log((F.col("pos") / n[1]) / ((F.col("neg") + 0.5) / n[0]))
    top = stats.where("pos >= 2").withColumn("lift", lift).where("lift > 0").orderBy(F.desc("lift"), "s").limit(CANDIDATES).collect()
    if not top:
        return None
    some = stats.where("pos >= 2")
    passed = discoveries([tuple(r) for r in some.groupBy("pos", "neg").count().collect()], n[1] / (n[0] + n[1]))
    spark = docs.sparkSession
    clear = some.join(F.broadcast(spark.createDataFrame(passed, "pos long, neg long")), ["pos", "neg"]).select("s", "pos", "neg").collect()
    rates = {r["s"]: r["neg"] / n[0] for r in clear}
    pos = {r["s"]: r["pos"] for r in [*top, *clear]}
    names = F.broadcast(spark.createDataFrame([(s,) for s in rates], "s string"))
    found = bags.where("toxic = 1").withColumn("id", F.monotonically_increasing_id()).select("id", F.explode("strings").alias("s")).join(names, "s").groupBy("id").agg(F.collect_set("s").alias("s")).collect()
    words = cover([r["s"] for r in found], rates, LEAST) or [top[0]["s"]]
    usual = stats.where("neg > 0").orderBy(F.desc("neg"), "s").limit(NEGATIVES // 2).collect()
    other = stats.where("neg > 0").orderBy(F.xxhash64("s"), "s").limit(NEGATIVES // 2).collect()
    negative = {r["s"]: r["neg"] for r in [*usual, *other]}
    marks = list(dict.fromkeys([*words, *[s for s in sorted(negative, key=negative.get)][: LANDMARKS // 4], *[r["s"] for r in top]]))[: max(LANDMARKS, len(words) + LANDMARKS // 2)]
    model = None
    for round_ in range(ROUNDS):
        base, cells = features(marks)
        values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        white = vectors[:, keep] / np.sqrt(values[keep])
        seen = {w: float(pos[w]) for w in words}
        near = {v: 0.2 * pos[w] for w in words for v in variants(w) if v not in negative}
        bad = {s: float(np.log1p(k)) for s, k in negative.items() if s not in seen}
        x = [*seen, *near, *bad]
        y = np.r_[np.ones(len(seen) + len(near)), -np.ones(len(bad))]
        c = np.r_[[1 + np.log1p(v) for v in [*seen.values(), *near.values()]], [1.0 + v for v in bad.values()]]
        step = max(1, 8_000_000 // len(cells))
        phi = np.concatenate([features(x[i : i + step], cells)[0] @ base.T for i in range(0, len(x), step)]).astype(np.float64) @ white
        w = fit_svm(phi, y, 10 * c)
        folded = np.zeros(LETTERS**ORDER, np.float32)
        folded[cells] = (white @ w[:-1]) @ base
        model = {"weights": folded, "bias": float(w[-1])}
        if round_ < ROUNDS - 1:
            hard = stats.where("neg > 0").select("s", "neg").mapInArrow(_valued(model["weights"], model["bias"]), "s string, neg long, value double")
            hardest = hard.orderBy(F.desc("value"), "s").limit(HARD).collect()
            negative |= {r["s"]: r["neg"] for r in hardest}
            marks = list(dict.fromkeys([*marks, *[r["s"] for r in hardest if r["s"] not in seen and r["value"] > 0][: len(words)]]))
    got = rows.mapInArrow(_decide(model["weights"], model["bias"], ["toxic"]), "toxic int, value double").collect()
    v, t = np.array([r["value"] for r in got]), np.array([r["toxic"] for r in got], float)
    model["slope"], model["offset"] = platt(v, t)
    model["words"] = words
    return model


def platt(v: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Logistic fit with smoothed targets, by damped Newton steps; the slope is never negative."""
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    x, w = np.c_[v, np.ones(len(v))], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (t - p) - 1e-4 * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return max(float(w[0]), 0.0), float(w[1])


def _valued(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(weights, bias)
        for batch in batches:
            value = machine.values(batch.column(0).to_pylist()).astype(float) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], ["s", "neg", "value"])

    return run


_MACHINES: dict[bytes, Machine] = {}


def _decide(weights: np.ndarray, bias: float, extra: list[str]):
    """From (text, *extra) to (*extra, value)."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = weights.tobytes()
        if key not in _MACHINES:  # one per worker and model
            _MACHINES.clear()
            _MACHINES[key] = Machine(weights, bias)
        machine = _MACHINES[key]
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    sets = [strings_of(t.as_py()) for t in part.column(0)]
                    machine.learn(sets)
                    known = machine.known
                    values = [max(map(known.__getitem__, s), default=FLOOR) for s in sets]
                    yield pa.RecordBatch.from_arrays([*[part.column(1 + i) for i in range(len(extra))], pa.array(values, pa.float64())], [*extra, "value"])
        finally:  # the worker goes on to other tasks
            machine.known.clear()
            machine.chars = 0
            pa.default_memory_pool().release_unused()

    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted."""
    rows = docs.select(text_of(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    valued = rows.mapInArrow(_decide(model["weights"], model["bias"], ["doc_id"]), "doc_id long, value double")
    chance = 1 / (1 + F.exp(-(F.col("value") * model["slope"] + model["offset"])))
    return valued.select("doc_id", chance.alias("score"), (chance >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under 0.5, all columns as they are; all rows where there is no model."""
    if model is None:
        return docs
    at, slope, offset = docs.columns.index(text_col), model["slope"], model["offset"]
    decide = _decide(model["weights"], model["bias"], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    parts.append(batch.slice(start, 512))
                    yield pa.RecordBatch.from_arrays([parts[-1].column(at).fill_null("")], ["text"])

        for found in decide(texts()):  # a batch for each part
            yield parts.pop().filter(pa.array(found.column(0).to_numpy() * slope + offset < 0))

    return docs.mapInArrow(run, docs.schema)
