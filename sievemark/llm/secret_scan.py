"""Secret scans: a random forest tells real findings from false ones; DataFrame functions and Spark ML only.

Candidates are the value runs of words (letters, digits and + / _ @ . - between other characters), each with its key and its place in the word: all that hold
a digit, all of at least LEAST characters, and shorter ones without a digit (passwords) where they are assigned by = or : or follow a word that announces a secret.
Left out are short runs of letters that nothing assigns or announces, as all prose consists of them. Values with other signs in them (! # $) or with
letters beyond ASCII are given as their runs; the password of an address (scheme://user:password@host) is a run of its own. Features: the value's length, shares of digits, capitals and distinct
characters, changes between letters and digits, how likely its pairs of letters are in the words of the corpus, how much of it are words of the corpus (those of KNOWN documents or more, of any
script; both counted over all documents), the path, and
the words around it. The forest learns from labelled findings, a bounded sample of them. No table holds any, so planted() makes them: into the words of documents it writes
values whose truth is known because it wrote them, secrets and the look-alikes that fill code and logs (digests, identifiers, versions, addresses, paths, settings); the forest sees no kind,
only features. With them it learns from untouched() candidates of the documents themselves, prose for the most part, as false ones: a secret among those that no pattern knows counts as false too,
which costs as much recall as such secrets are common among candidates. Many pairs of kinds have the same form, such as 40 hexadecimal digits after `token` and after `commit`, so that only length, covering words, place and words nearby tell them apart.
by_rule() is what patterns alone say, for comparison; no score comes from it.

Defined results: null and empty texts have no candidates; null paths count as empty; without labelled findings of both kinds all scores are 0;
labelled findings that are alike each count; repeated rows give repeated findings; an empty table gives an empty result; other columns are not read. Values are given as SHA-256 only.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of, written

LEAST, KNOWN = 12, 2
PAIRS, RARE = 4096, -9.0
"""Pairs of letters that are kept, the commonest; the log chance that others count with."""
SAMPLE = 20_000
"""Labelled findings of each label that training takes at most: those with the lowest hashes."""
DOCUMENTS, EACH = 5_000, 6
"""Documents that get planted values, about, and how many each: with the lowest hashes of their ids."""
TREES, DEPTH, SEED = 25, 6, 7
# Words that announce a secret, and words of places where examples live.
ANNOUNCING = "token|secret|key|password|passwd|pwd|api|auth|bearer|credential|private"
ANNOUNCED = rf"(?i)({ANNOUNCING})s?[\"'`]?[=:]?$"
RUN = "[+/_@.-]*[A-Za-z0-9][A-Za-z0-9+/_@.-]*"
EXAMPLES = "test|example|sample|mock|fixture|dummy|doc"
FEATURES = ("length", "digits", "capitals", "distinct", "changes", "dots", "signs", "coverage", "fluency", "path_length", "path_example", "announced", "assigned", "quoted", "example_near", "number_next")


def vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words, pairs): (word, n) of every lower-case word of letters with the documents that hold it, and (pair, chance) of the PAIRS commonest pairs of letters: the log chance of the second
    letter after the first, over the words as often as documents hold them."""
    each = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    words = written(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    pairs = words.where("length(word) > 1").select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("_c")).agg(F.sum("n").alias("_n"))
    pairs = pairs.join(first, F.substring("pair", 1, 1) == F.col("_c")).orderBy(F.desc("n"), "pair").limit(PAIRS)
    return words, written(pairs.select("pair", F.log(F.col("n") / F.col("_n")).alias("chance")), "pairs")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, position, word, before, before2, after, place, value, key) of every candidate."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.split(text_of(text_col), r"\s+").alias("words"))
    near = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    led = lambda before, before2: before.rlike("[=:]$") | before.rlike(ANNOUNCED) | (before.rlike("^([=:>-]+|is|was)$") & before2.rlike(ANNOUNCED))
    worth = lambda i: near(i).rlike("[0-9=:]") | (F.length(near(i)) >= LEAST) | led(near(i - 1), near(i - 2))
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), worth)
    each = words.select("doc_id", "path", F.explode(F.transform(hits, lambda i: F.struct(i.alias("position"), near(i).alias("word"), near(i - 1).alias("before"), near(i - 2).alias("before2"), near(i + 1).alias("after")))).alias("c")).select("doc_id", "path", "c.*")
    each = each.withColumn("_plain", F.regexp_replace("word", "(://[^/@:]*:[^/@]*)@", "$1,"))
    each = each.withColumns({"_runs": F.regexp_extract_all("_plain", F.lit(RUN), F.lit(0)), "_between": F.split("_plain", RUN)})
    runs = each.select("*", F.posexplode("_runs").alias("place", "value")).withColumn("_assigned", F.get("_between", F.col("place")).rlike("[=:]"))
    runs = runs.withColumn("key", F.when(F.col("_assigned") & (F.col("place") > 0), F.regexp_replace(F.get("_runs", F.col("place") - 1), "^[+/_@.-]+", "")).otherwise(""))
    taken = F.col("value").rlike("[0-9]") | (F.length("value") >= LEAST) | F.col("_assigned") | ((F.col("place") == 0) & led(F.col("before"), F.col("before2")))
    return runs.where(taken).drop("_plain", "_runs", "_between", "_assigned")


def _language(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(value, coverage, fluency) of every distinct value: the share of it that known words make up, and the mean log chance of its pairs of letters, RARE if it has none."""
    values = found.select("value").distinct()
    run = F.explode(F.split(F.lower(F.regexp_replace("value", "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+"))
    runs = values.select("value", run.alias("word")).where("length(word) > 2")
    covered = runs.join(words.where(F.col("n") >= KNOWN), "word").groupBy("value").agg(F.sum(F.length("word")).alias("_k"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.lower(F.substring("value", i, 2))))
    two = values.where("length(value) > 1").select("value", pair.alias("pair")).where("pair rlike '^[a-z]{2}$'")
    fluent = two.join(F.broadcast(pairs), "pair", "left").groupBy("value").agg(F.avg(F.coalesce("chance", F.lit(RARE))).alias("fluency"))  # PAIRS rows
    out = values.join(covered, "value", "left").join(fluent, "value", "left")
    return out.select("value", (F.coalesce("_k", F.lit(0)) / F.length("value")).alias("coverage"), F.coalesce("fluency", F.lit(RARE)).alias("fluency"))


def featured(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """found with the columns FEATURES."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n
    around = F.lower(F.concat_ws(" ", "key", "before", "before2"))
    cols = {
        "length": n.cast("double"), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "changes": F.regexp_count(v, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / n, "dots": share("[^.]"), "signs": share("[^@_+/-]"),
        "path_length": F.length("path").cast("double"), "path_example": F.lower("path").rlike(EXAMPLES).cast("double"), "announced": around.rlike(ANNOUNCING).cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | (F.col("key") != "")).cast("double"), "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "example_near": F.lower(F.concat_ws(" ", "word", "before", "before2", "after")).rlike(EXAMPLES).cast("double"), "number_next": F.col("after").rlike("^[0-9]").cast("double"),
    }
    return found.join(_language(found, words, pairs), "value").withColumns(cols)


def by_rule(found: DataFrame) -> DataFrame:
    """found with `rule`: 1 where a pattern with its announcing word says secret."""
    v = F.col("value")
    around = F.lower(F.concat_ws(" ", "key", "before", "before2"))
    secret = v.rlike("^AKIA[0-9A-Z]{16}$") | v.rlike("^gh[pousr]_[A-Za-z0-9]{36}$") | (v.rlike("^([0-9a-f]{16,64}|[A-Za-z0-9+/]{32,})$") & around.rlike(ANNOUNCING))
    return found.withColumn("rule", secret.cast("int"))


# (label, text before, value, text after). {h40}: 40 hexadecimal digits; m, u, d: mixed letters and digits, capitals and digits, digits; w, W: a word of the document; a letter b to e takes another piece.
KINDS = [
    (1, 'token = "', "{h40}", '"'), (1, "password=", "{m12}", ""), (1, "api_key='", "{m32}", "'"), (1, '{"aws":"', "AKIA{u16}", '","env":"prod"}'), (1, "", "ghp_{m36}", ""), (1, "Authorization: Bearer ", "{m40}", ""),
    (1, "secret=", "{h32}", "&region=us"), (1, "postgres://app:", "{m10}", "@db.local/main"), (1, "pwd: ", "{W}{d3}", ""), (1, "https://x.local/cb?token=", "ghp_{m36}", "&state=1"), (1, "aws=", "AKIA{u16}", ""), (1, "password=", "{h18}", ""),
    (0, "commit ", "{h40}", ""), (0, "sha256:", "{h64}", ""), (0, "id=", "{d8}", ""), (0, '{"session":"', "{h8}-{bh4}-{ch4}-{dh4}-{eh12}", '","n":1}'), (0, "", "{d2}.{bd2}.{cd2}.{dd1}", ""), (0, "mail ", "{w}.{d2}@mail.example.com", ""),
    (0, "/usr/lib/", "{w}-{d1}.{bd2}.tar.gz", ""), (0, "version ", "v{d1}.{bd2}.{cd1}", ""), (0, "?page=", "{d2}", "&lang=en"), (0, "img/", "{h16}.png", ""), (0, "call ", "+{d2}-{bd7}", ""), (0, "", "{w}{w}{w}", ""),
    (0, 'token = "', "your-token-{d2}", '"'), (0, "key=", "test-key-{w}", ""), (0, "etag ", "{m32}", ""), (0, "trace=", "{h32}", ""),
]


def untouched(found: DataFrame) -> DataFrame:
    """Candidates of the documents that no pattern knows, with label 0."""
    return by_rule(found).where("rule = 0").drop("rule").withColumn("label", F.lit(0.0))


def _filled(template: Column, salt: Column, word: Column) -> Column:
    """A value of KINDS with its pieces put in, all from hashes of `salt` but the words."""
    for name in sorted({x for *_, v, _ in KINDS for x in re.findall("{([a-z]*[0-9]+)}", v)}):
        kind, n = re.fullmatch("([b-e]?[hmud])([0-9]+)", name).groups()
        h = F.sha2(F.concat(salt, F.lit("/" + kind)), 256)
        if kind[-1] == "d":
            h = F.translate(h, "abcdef", "904172")
        elif kind[-1] in "mu":
            h = F.translate(F.base64(F.unhex(h)), "+/=", "kQ7")
        template = F.replace(template, F.lit("{" + name + "}"), F.substring(F.upper(h) if kind[-1] == "u" else h, 1, int(n)))
    return F.replace(F.replace(template, F.lit("{w}"), word), F.lit("{W}"), F.initcap(word))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Candidates with label and kind, planted between words of a bounded sample of documents: each by its place in the text, so with the words and the path that surround it there."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("text")).where("id is not null and length(text) > 0")
    n = max(1, rows.count())
    rank = F.pmod(F.xxhash64(F.lit("plant"), "id"), F.lit(1 << 30)) / (1 << 30)
    some = rows.where(rank < DOCUMENTS / n).withColumn("w", F.split("text", r"\s+")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(EACH - 1))))
    some = some.withColumn("salt", F.concat_ws("/", "id", "i")).withColumn("at", F.pmod(F.xxhash64("salt"), F.size("w")).cast("int"))
    near = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    plain = F.regexp_replace(F.lower(near(F.col("at"))), "[^a-z]", "")
    word = F.when(F.length(plain) > 2, plain).otherwise(F.lit("river"))
    kinds = F.broadcast(docs.sparkSession.createDataFrame([(i, float(label), *k) for i, (label, *k) in enumerate(KINDS)], "kind int, label double, lead string, template string, trail string"))  # KINDS alone
    some = some.select("salt", "path", word.alias("near_word"), *[near(F.col("at") + i).alias(f"w{i + 2}") for i in (-2, -1, 0, 1)], F.pmod(F.xxhash64(F.lit("kind"), "salt"), F.lit(len(KINDS))).cast("int").alias("kind"))
    made = some.join(kinds, "kind").withColumn("planted", _filled(F.col("template"), F.col("salt"), F.col("near_word")))
    made = made.select(
        F.concat(F.col("salt"), F.lit("#"), F.col("path")).alias("salt"), "path", F.concat_ws(" ", "w0", "w1", F.concat("lead", "planted", "trail"), "w2", "w3").alias("text"), "label", "planted", "kind",
    )
    found = candidates(made, "salt", "text", "path").withColumnRenamed("doc_id", "salt")
    return found.join(made.select(F.col("salt").alias("_salt"), "label", "planted", "kind"), F.col("salt") == F.col("_salt")).where(F.regexp_replace("value", "^[+/_@.-]+|[.]+$", "") == F.col("planted")).withColumnRenamed("salt", "doc_id").drop("_salt", "planted")


def fit(findings: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (the columns FEATURES and label); None unless both labels are there."""
    names = [c for c in ("doc_id", "position", "place", "value") if c in findings.columns]
    ranked = findings.where("label in (0, 1)").select(*FEATURES, "label", F.xxhash64(F.lit("finding"), *names, F.monotonically_increasing_id()).alias("_h"))
    ranked = written(ranked, "findings")
    rows = ranked.where("label = 1").orderBy("_h").limit(sample).unionByName(ranked.where("label = 0").orderBy("_h").limit(sample))
    rows = written(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", F.col("label").cast("double").alias("label")), "learned")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def score(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """found with score and predicted."""
    if model is None:
        return found.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    out = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(found).withColumnRenamed("_x", "x"))
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("x", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, position, place, value_sha256, length, score, predicted) of every candidate: position of its word, place in the word.

    findings: labelled ones to learn from, with the columns of candidates() and label; else planted()'s."""
    words, pairs = vocabulary(docs, text_col)
    # What a value says of itself is joined to its candidates, so these are written before.
    found = written(featured(written(candidates(docs, id_col, text_col, path_col), "candidates"), words, pairs), "featured")
    if findings is None:
        made = featured(written(planted(docs, id_col, text_col, path_col), "planted"), words, pairs)
        names = [*FEATURES, "label", "doc_id", "position", "place", "value"]
        findings = made.select(*names).unionByName(untouched(found).withColumn("doc_id", F.col("doc_id").cast("string")).select(*names))
    else:
        findings = featured(findings, words, pairs)
    model = fit(findings)
    return score(found, model).select("doc_id", "position", "place", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("long").alias("length"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
