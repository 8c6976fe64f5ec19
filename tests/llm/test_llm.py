"""The operators of the llm subpackage: edge cases, and brute force where SQL can't tell."""

import base64
import binascii
import collections
import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import byte_bpe, chat, common, exact_dedup, mixing, near_dedup, queries, ring_shard, secret_scan, shingles, spotsigs, suffix_dedup, toxicity
from sievemark.llm.components import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=600):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, control strings."""
    rng = random.Random(4)
    long = prose(rng, 20_000)
    texts = [None, "", " \n\t", "a", "é ü　ß \U0001f600", long, long, prose(rng, 40), "\\### x </turn> <b>\r\n", "\x00nul\x00"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "no id", None, None, None), (None, "no id", None, None, None), (50, prose(random.Random(4), 39), None, "s1", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names operators use themselves."""
    clash = ["digest", "row", "key", "bands", "keep", "size", "rank", "slot", "ids", "score", "text_sha256", "part", "value"]
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit(1) for c in clash}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return t or ""


def test_queries_with_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        want = c.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        assert sorted(tuple(str(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(str(r[want.columns.index(x)]) for x in cols) for r in want.fetchall())


# -- 1

INSULTS = ["vlorpat", "grumek", "zentdul"]


def toxic_rows(rng, n, start=0):
    out = []
    for i in range(start, start + n):
        words = [rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice("ra ti on ul em is".split()) + rng.choice("na lo shi ke".split()) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            words.insert(rng.randrange(30), rng.choice(INSULTS))
        out.append((i, " ".join(words), "en", "s", 0, int(bad)))
    return out


def test_toxicity_tolerates_gaps(spark):
    data = toxic_rows(random.Random(1), 300)
    docs = spark.createDataFrame([r[:5] for r in data], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5]) for r in data] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model["words"]) & set(INSULTS)
    new = toxic_rows(random.Random(2), 100, 1000)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([r[:5] for r in new], SCHEMA), model).collect()}
    assert np.mean([got[r[0]].predicted == r[5] for r in new]) >= 0.97
    hidden = ["cdtike g.r.u.m.e.k abrana", "cdtike g r u m e k abrana", "cdtike gruxmek abrana", "VLORPAAT!", "zen-tdul"]
    r = toxicity.score(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(hidden)], SCHEMA), model).collect()
    assert all(x.predicted for x in r)


def test_toxicity_learns_rare_insults(spark):
    """More kinds than 32, each in about 1% of the toxic documents."""
    rng = random.Random(6)
    kinds = ["".join(rng.choice("qwxzvj") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    bad = [k for k in kinds for _ in range(8)] + ["vlorpat"] * 400
    clean = [" ".join(r[1].split()[:29]) for r in toxic_rows(rng, 3000) if not r[5]]
    rows = [(i, f"{clean[i]} {bad[i]}" if i < len(bad) else clean[i], "en", "s", 0) for i in range(len(clean))]
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(r[0], int(r[0] < len(bad))) for r in rows], "doc_id long, toxic int"))
    trained = collections.Counter(b for i, b in enumerate(bad) if binascii.crc32(str(i).encode()) % 5)
    known = {k for k in kinds if trained[k] >= 5}
    assert known <= set(model["words"]) and len(known) > 32
    new = [(i, f"cdtike {k} abrana", "", "", 0) for i, k in enumerate(kinds)] + [(100 + i, t, "", "", 0) for i, t in enumerate(clean[:200])]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(new, SCHEMA), model).collect()}
    assert sum(got[i] for i in range(40)) >= 38 and sum(v for i, v in got.items() if i >= 100) <= 2


def test_discoveries_need_more_than_chance():
    """One document more says nothing; the smallest passing count doesn't grow with the sample."""
    counts = [(2, 8, 500), (2, 0, 50), (5, 0, 10), (40, 1, 3)]
    assert set(toxicity.discoveries(counts, 0.1)) >= {(5, 0), (40, 1)} and (2, 8) not in toxicity.discoveries(counts, 0.1)
    assert toxicity.discoveries([(2, 2, 9)], 0.5) == [] == toxicity.discoveries([], 0.5)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), None):
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, None).count() == 0
    assert toxicity.fit(none, labels) is None


def test_kernel_is_the_subsequence_kernel():
    """Dot products of feature vectors against a count of all common subsequences."""
    import itertools

    def phi(w):
        out = collections.Counter()
        for at in itertools.combinations(range(len(w)), 3):
            out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["idiot", "idixot", "banana", "aaaa"]
    x, _ = toxicity.features(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            p, q = phi(a), phi(b)
            want = sum(p[k] * q[k] for k in p) / (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5
            assert float(x[i] @ x[j]) == pytest.approx(want, abs=1e-5)


# -- 2

def test_bpe_is_tiktoken(spark, odd, none):
    import tiktoken

    path, pattern = byte_bpe.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_decode(odd, path, pattern).collect()
    want = [(r[0], text_of(r[1])) for r in odd_rows()]
    expected = sorted((str(i), struct.pack(f"<{len(x)}I", *x), t.encode()) for i, t in want for x in [own.encode_ordinary(t)])
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == expected
    assert byte_bpe.encode_decode(none, path, pattern).count() == 0
    assert byte_bpe.encode_documents(odd, path, pattern).count() == len(want)


# -- 3

def test_ring_is_balanced_and_gapless(spark, odd, none):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text")))
    rows = ring_shard.assign(docs, 7, 16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 1300 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    odd_rows_ = ring_shard.assign(odd, 4, 8).collect()
    assert len(odd_rows_) == odd.count() and {r.size for r in odd_rows_ if r.doc_id == 0} == {16}
    assert ring_shard.assign(none, 4, 8).count() == 0


def test_ring_keeps_equal_texts_together(spark):
    """A group is parted only where an entry of an arc's way ends; one of a third of the rows goes on over several shards."""
    rows = [(i, f"text {i % 400}" if i % 3 else "hot") for i in range(1800)]
    got = ring_shard.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8, 16).collect()
    shards, text = collections.defaultdict(set), dict(rows)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    parted = {t for t, s in shards.items() if len(s) > 1}
    assert "hot" in parted and len(parted) <= 1 + 8 + 16
    many = spark.createDataFrame([(5, "x")] * 40, "doc_id long, text string")
    assert sorted(r.n for r in common.expanded(many.groupBy("doc_id").agg(F.count("*").alias("c"), F.lit(3).cast("long").alias("f")), "f", "c", "n", 7).collect()) == list(range(3, 43))


def test_ring_walk_against_one_key_at_a_time():
    rng = random.Random(3)
    points = ring_shard.ring(5, 6)
    counts = [rng.randrange(8) for _ in points]
    room = ring_shard.capacities(sum(counts), 5)
    left, want = list(room), collections.Counter()
    rest = []
    for a, (_, s) in enumerate(points):
        n = min(counts[a], left[s])
        left[s] -= n
        want[a, s] += n
        rest.append(counts[a] - n)
    for a in range(len(points)):
        at = a
        while rest[a]:
            s = points[at][1]
            if left[s]:
                left[s] -= 1
                want[a, s] += 1
                rest[a] -= 1
            else:
                at = (at + 1) % len(points)
    got = collections.Counter()
    for a, lo, hi, s, _ in ring_shard.ways(points, counts, room):
        got[a, s] += hi - lo + 1
    assert got == +want


def test_ring_moves_few_keys_when_it_grows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b = ({r.doc_id: r.home for r in ring_shard.assign(docs, n, 64).collect()} for n in (10, 11))
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 10 for k in moved) and 0.03 < len(moved) / 4000 < 0.16


# -- 4

def brute_classes(texts):
    """Classes of (id, text) by all pairs, with the sketch's own idf."""
    s = shingles.Shingler(5)
    f = {i: s(t) for i, t in texts}
    counts = np.zeros((near_dedup.DEPTH, 1 << near_dedup.WIDTH_BITS), np.int64)
    for x, _ in f.values():
        for d in range(near_dedup.DEPTH):
            np.add.at(counts[d], near_dedup._cells(x, d, near_dedup.WIDTH_BITS), 1)
    idf = near_dedup.Idf(counts, len(texts))
    w = {i: (x, n * idf(x)) for i, (x, n) in f.items()}
    up = {i: i for i, _ in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, t in texts:
        for j, u in texts:
            if i < j and (t == u or (t.split() and u.split() and near_dedup.weighted_jaccard(w[i], w[j]) >= 0.8)):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i, _ in texts}


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(9)
    texts = []
    for g in range(12):
        base = prose(rng, rng.choice([8, 60, 200])).split()
        for k in range(rng.choice([1, 3, 6])):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += ["", "", "one two", "one two", texts[3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(df).collect()}
    want = brute_classes(rows)
    assert got == want
    kept = near_dedup.deduplicate(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_classes_of_wide_buckets(spark, monkeypatch):
    """Buckets of many small blocks: a group of near copies, some far from most others, and texts that share a passage."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 6)
    rng, rows = random.Random(5), []
    base = prose(rng, 80).split()
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 9])):
            t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:40]) + " " + prose(rng, 12, 10**6)) for i in range(30)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and 2 < len(set(got.values())) < 90


def test_similarities_against_one_pair_at_a_time():
    """Features of few and of many texts, with different weights."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 120, dtype=np.uint64))
    texts = []
    for i in range(70):
        f = np.unique(np.r_[base[rng.random(len(base)) < 0.8], base[:9] + np.uint64(i // 5), rng.integers(0, 1 << 62, 7, dtype=np.uint64)])
        texts.append((f, rng.integers(1, 60, len(f)).astype(np.uint32)))
    got = near_dedup.similarities(texts)
    for i in range(0, 70, 9):
        for j in range(70):
            assert got[i, j] == pytest.approx(near_dedup.weighted_jaccard(texts[i], texts[j]), abs=1e-9)


def test_idf_depends_on_shares_only(spark):
    """The same share of documents gives the same step at any size of the corpus; rare shingles all have the largest."""
    steps = []
    for n in (2000, 32000):
        counts = np.full((near_dedup.DEPTH, 1 << near_dedup.WIDTH_BITS), n // 200, np.int64)
        f = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for d in range(near_dedup.DEPTH):
            counts[d, near_dedup._cells(f, d, near_dedup.WIDTH_BITS)] += (n * np.array([1, 0.5, 0.1, 0.01, 0])).astype(int)
        steps.append(near_dedup.Idf(counts, n)(f).tolist())
    assert steps[0] == steps[1] == [8, 9, 11, 13, 16]


def test_near_odd_rows(spark, odd, none):
    rows = near_dedup.near_groups(odd).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == len({r.class_id for r in rows})
    assert near_dedup.deduplicate(odd).columns == odd.columns
    assert near_dedup.near_groups(none).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    s, hits, n = near_dedup.Sampler(), [], 300
    for _ in range(n):
        f = np.unique(rng.integers(0, 1 << 63, 130, dtype=np.uint64))
        a, b = f[:115], f[10:]
        x, y = s.bands(a, np.full(len(a), 16)), s.bands(b, np.full(len(b), 16))
        hits.append((x == y).mean())
    j = 105 / 130
    assert np.mean(hits) == pytest.approx(j**4, abs=0.06)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.key: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    for _ in range(100):
        for a, b in links:
            m = min(up.get(a, a), up.get(b, b))
            up[a] = up[b] = m
    assert got == {k: v for k, v in up.items() if any(k in l and l[0] != l[1] for l in links)}


# -- 5

def test_exact_groups(spark, odd, none):
    rows = exact_dedup.exact_groups(odd, k=2).collect()
    by = collections.defaultdict(list)
    for r in odd_rows():
        by[hashlib.sha256(text_of(r[1]).encode()).hexdigest()].append(r[0])
    assert len(rows) == len(odd_rows())
    for r in rows:
        group = by[r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(by)
    assert exact_dedup.deduplicate(odd, k=2).count() == len(by) and exact_dedup.exact_groups(none).count() == 0


def test_misra_gries_finds_all_frequent(spark):
    rng = random.Random(1)
    keys = [b"a"] * 400 + [b"b"] * 300 + [str(rng.random()).encode() for _ in range(800)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "digest binary").repartition(7)
    found = {bytes(r.digest) for r in exact_dedup.heavy_digests(df, 5).collect()}
    assert {b"a", b"b"} <= found and len(found) <= 5


# -- 6

def test_secrets(spark, odd, none):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    data = []
    for i in range(200):
        word = " ".join(rng.choice(["alpha", "beta", "river"]) for _ in range(6))
        t = [f'{word} token = "{hexes(40)}" {word}', f"{word} password={hexes(18)} {word}", f"{word} 192.168.{rng.randrange(256)}.{rng.randrange(256)} {word}", f"{word} u{i}.river@mail{i}.example.com {word}"][i % 4]
        data.append((i, t, "en", "src/app.py", 0))
    docs = spark.createDataFrame(data, SCHEMA)
    got = {r.doc_id: r.predicted for r in secret_scan.scan(docs).collect()}
    assert all(got[i] == (i % 4 < 2) for i in got) and len(got) > 190
    assert secret_scan.scan(none).count() == 0


def test_secrets_of_odd_rows(spark, odd):
    """Nulls, empty texts and repeated rows: the candidates are those of a split by hand; repeated rows repeat theirs."""
    got = collections.Counter((r.doc_id, r.position, r.place) for r in secret_scan.scan(odd).collect())
    want = collections.Counter()
    for i, t, *_ in odd_rows():
        for at, w in enumerate(re.split(r"\s+", text_of(t), flags=re.ASCII)):
            for place, run in enumerate(re.findall(r"[+/_@.-]*[A-Za-z0-9][A-Za-z0-9+/_@.-]*", w)):
                if re.search("[0-9]", run) or len(run) >= secret_scan.LEAST:
                    want[i, at, place] += 1
    assert got == want


def test_features_by_hand(spark):
    found = secret_scan.candidates(spark.createDataFrame([(1, 'the river token = "ab12CD34_theriver.x" 77 end', "", "tests/a.py", 0)], SCHEMA))
    words = spark.createDataFrame([("the", 9), ("river", 2), ("end", 1)], "word string, n long")
    pairs = spark.createDataFrame([("ab", -1.0), ("th", -2.0), ("ri", -3.0)], "pair string, chance double")
    r = secret_scan.featured(found, words, pairs).where("length > 10").first()
    two = ["ab", "cd", "th", "he", "er", "ri", "iv", "ve", "er"]
    assert r.fluency == pytest.approx(sum({"ab": -1, "th": -2, "ri": -3}.get(t, secret_scan.RARE) for t in two) / len(two))
    v = "ab12CD34_theriver.x"
    assert r.value == v and r.length == len(v)
    assert [round(r[c], 6) for c in ("digits", "capitals", "distinct", "changes", "dots", "signs", "coverage")] == [round(x / len(v), 6) for x in (4, 2, len(set(v)), 3, 1, 1, 0)]
    assert [r[c] for c in ("path_length", "path_example", "announced", "assigned", "quoted", "example_near", "number_next")] == [10, 1, 1, 1, 1, 0, 1]


def test_forest_from_few_equal_findings(spark):
    """40 equal secrets and 50 equal addresses: any sample holds both labels; one label alone gives no forest."""
    rows = [(i, f"token={'a1b2' * 10}", "", "src/a.py", 0) for i in range(40)] + [(100 + i, "at 10.0.0.1 x", "", "src/a.py", 0) for i in range(50)]
    found = secret_scan.featured(secret_scan.candidates(spark.createDataFrame(rows, SCHEMA)).where("value rlike '[0-9]'"), *secret_scan.vocabulary(spark.createDataFrame(rows, SCHEMA))).withColumn("label", (F.col("doc_id") < 100).cast("double"))
    for n in (1, 2, 3, 5):
        model = secret_scan.fit(found, n)
        assert {(r.label, r.predicted) for r in secret_scan.score(found, model).select("label", "predicted").collect()} <= {(0.0, 0), (1.0, 1), (1.0, 0), (0.0, 1)}
    assert secret_scan.fit(found.where("label = 1")) is None
    assert secret_scan.score(found, None).where("score > 0 or predicted > 0").count() == 0


def test_vocabulary(spark):
    rows = [(1, "Die die Fluss, Über ab", "", "", 0), (2, "die ab12ab Москва", "", "", 0), (3, None, "", "", 0)]
    words, pairs = secret_scan.vocabulary(spark.createDataFrame(rows, SCHEMA))
    n = {r.word: r.n for r in words.collect()}
    assert n == {"die": 2, "fluss": 1, "über": 1, "ab": 2, "москва": 1}
    chance = {r.pair: r.chance for r in pairs.collect()}
    assert chance["ab"] == 0 and chance["ss"] == 0 and chance["be"] == 0 and chance["ie"] == 0 and chance["ск"] == 0


@pytest.fixture(scope="module")
def secrets(spark):
    """Featured candidates of the given documents, and planted ones."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    language = secret_scan.vocabulary(docs)
    found = common.written(secret_scan.featured(secret_scan.candidates(docs), *language), "found")
    made = common.written(secret_scan.featured(secret_scan.planted(docs), *language), "planted")
    return found, made


def learn(found, made):
    names = [*secret_scan.FEATURES, "label", "value"]
    return secret_scan.fit(made.select(*names).unionByName(secret_scan.untouched(found).select(*names)))


def test_forest_on_held_out_kinds(secrets):
    """A third of the kinds is left out of training at a time; the rest of the documents' candidates teach what prose is."""
    found, made = secrets
    rows = []
    for k in range(3):
        part = F.col("kind") % 3 == k
        model = learn(found, made.where(~part))
        rows += secret_scan.by_rule(secret_scan.score(made.where(part), model)).select("kind", "label", "predicted", "rule").collect()
    hit = sum(r.predicted and r.label for r in rows)
    precision, recall = hit / max(1, sum(r.predicted for r in rows)), hit / sum(r.label for r in rows)
    rule = sum(r.rule and r.label for r in rows) / sum(r.label for r in rows)
    by_kind = {k: (sum(r.predicted for r in rows if r.kind == k), sum(1 for r in rows if r.kind == k)) for k in sorted({r.kind for r in rows})}
    print("kinds never seen: precision, recall, the rule's recall:", precision, recall, rule, by_kind)
    assert len(rows) > 2000 and precision > 0.6 and recall > 0.6


def test_forest_beats_the_rule_on_held_out_findings(secrets):
    found, made = secrets
    late = F.pmod(F.crc32(F.substring_index("doc_id", "/", 1)), F.lit(5)) == 0
    rows = secret_scan.by_rule(secret_scan.score(made.where(late), learn(found, made.where(~late)))).select("label", "predicted", "rule").collect()

    def figures(name):
        hit = sum(r[name] and r.label for r in rows)
        return hit / max(1, sum(r[name] for r in rows)), hit / sum(r.label for r in rows)

    forest, rule = figures("predicted"), figures("rule")
    print("precision and recall, forest and rule:", forest, rule, len(rows))
    assert len(rows) > 500 and min(forest) > 0.85 and sum(forest) > sum(rule)
    assert any(r.predicted != r.rule and r.predicted == r.label for r in rows)


def test_predictions_on_unplanted_text(secrets):
    """Of what is called a secret in the given documents, next to nothing is without a digit and an announcing word."""
    found, made = secrets
    hits = secret_scan.by_rule(secret_scan.score(found, learn(found, made))).where("predicted = 1").collect()
    plain = [r.value for r in hits if not re.search("[0-9]", r.value) and not r.announced]
    print("predicted, by the rule too, plain:", len(hits), sum(r.rule for r in hits), plain[:9])
    assert hits and len(plain) <= 0.05 * len(hits)
    assert sum(r.rule for r in hits) >= 0.8 * found.transform(secret_scan.by_rule).where("rule = 1").count()


def test_secrets_anywhere_in_a_word(spark):
    key, other = "AKIA" + "Q7" * 8, "ghp_" + "a1B2" * 9
    hidden = [f'{{"aws":"{key}","env":"prod"}}', f"aws={key}&region=us", f"https://x/cb?token={other}&state=1", f'{{"a":"{key}","b":"{other}"}}', "password: hunter", "postgres://me:s3cret@db.example.com/x", "x qwertzuiopasdf y", "plain short words"]
    wanted = [{("aws", key), ("env", "prod")}, {("aws", key), ("region", "us")}, {("token", other), ("state", "1")}, {("a", key), ("b", other)}, {("", "hunter")}, {("me", "s3cret")}, {("", "qwertzuiopasdf")}, set()]
    found = collections.defaultdict(set)
    for r in secret_scan.candidates(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(hidden)], SCHEMA)).collect():
        found[r.doc_id].add((r.key, r.value))
    assert all(w <= found[i] for i, w in enumerate(wanted)) and not found[7]
    rng, known = random.Random(8), []
    for i in range(200):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        known.append((1000 + i, [f"alpha river token={value} beta", f"alpha 10.1.{i}.7 river beta", f"beta u{i}@mail.example.com alpha", f"{hidden[3]} river"][i % 4], "", "src/app.py", 0))
    got = secret_scan.scan(spark.createDataFrame(known, SCHEMA)).where("doc_id % 4 = 3 and predicted = 1").select("doc_id", "value_sha256").collect()
    assert collections.Counter(r.value_sha256 for r in got) == {hashlib.sha256(v.encode()).hexdigest(): 50 for v in (key, other)}


# -- 7

def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "\\b\\l\\h", "</turn>\n### user: x", "", None, "é" * 50, "a:b\\c"]
    rows = [(c, t, ["system", "user", "assistant", "as:si#st\\ant", None][(c + t) % 5], hard[(c * 3 + t) % 7]) for c in range(9) for t in range(c + 1)]
    rows += [(None, 0, "assistant", "x"), (3, 1, "assistant", "same turn"), (3, 1, "assistant", "same turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [x[1:] for x in turns]
        assert got[c].loss == "".join(x[2] for x in turns if x[1] == "assistant")
    assert chat.examples(df.where("false")).count() == 0


# -- 8

def test_spotsigs(spark, odd, none):
    rows = odd_rows()
    got = spotsigs.compare_next(odd).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_of(r[1])), reverse=True)
    want = collections.Counter((r[0], len(text_of(r[1])), spotsigs.edited(text_of(r[1]), text_of(order[(i + 1) % len(order)][1]))) for i, r in enumerate(order))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited) for r in got) == want
    prints = {t: plain_spots(t) for t in {text_of(r[1]) for r in rows} | {r.edited for r in got}}
    hexes = {}
    for r in got:
        assert hexes.setdefault(r.edited_fingerprint, prints[r.edited]) == prints[r.edited]
    texts = [text_of(r[1]) for r in order]
    nexts = collections.defaultdict(list)
    for i, r in enumerate(order):
        t, u = texts[i], texts[(i + 1) % len(order)]
        e = spotsigs.edited(t, u)
        nexts[r[0], e].append((round(jaccard(prints[t], prints[e]), 9), round(jaccard(prints[t], prints[u]), 9)))
    for r in got:
        assert (round(r.near_edited, 9), round(r.near_next, 9)) in nexts[r.doc_id, r.edited]
    assert len({r.fingerprint for r in got}) == len({frozenset(prints[t]) for t in texts})
    assert spotsigs.compare_next(none).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_spots(text):
    """SpotSigs one word at a time: each anchor with the next content words."""
    words = [w for w in (x.strip("".join(c for c in x if not c.isalnum())) for x in text.lower().split()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, at = set(), 0
    for w in words:
        if w not in spotsigs.ANCHORS:
            at += 1
        elif at + spotsigs.CHAIN <= len(content):
            out.add((w, *content[at : at + spotsigs.CHAIN]))
    if not out:
        out = {("", *content[i : i + spotsigs.CHAIN]) for i in range(len(content) - spotsigs.CHAIN + 1)}
    return out or {("short", *words)}


def test_spots_of_many_null_ids(spark, monkeypatch):
    """Ranges by text among null ids: every row is compared with the next one, whatever the number of ranges."""
    monkeypatch.setattr(spotsigs, "SMALL_PART", 200)
    rng = random.Random(3)
    rows = [(i if i % 3 else None, prose(rng, 6, 10**6)) for i in range(90)] + [(None, ""), (None, "a"), (7, "z")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = collections.Counter((r[0], spotsigs.edited(r[1], order[(i + 1) % len(order)][1])) for i, r in enumerate(order))
    assert collections.Counter((r.doc_id, r.edited) for r in spotsigs.compare_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_spot_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    for g in range(10):
        base = [rng.choice(["the", "of", "and", f"c{rng.randrange(500)}"]) for _ in range(120)]
        for k in range(4):
            t = list(base)
            for _ in range(k * 2):
                t[rng.randrange(len(t))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(t))
    members, links = spotsigs.near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.7)
    s = spotsigs.Spots()
    sets = [s(t) for t in texts]
    rep = {r.doc_id: r.rep for r in members.collect()}
    want = {(i, j) for i in range(40) for j in range(40) if i < j and rep[i] == i and rep[j] == j and spotsigs.likeness(sets[i], sets[j]) >= 0.7}
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == want and want


# -- 9

def expected_targets(sizes):
    """By resharing the excess in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    cap = {s: 2.0 * sizes[s] for s in names}
    t = {s: 0.0 for s in names}
    left = 1.5 * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in names if t[s] < cap[s] - 1e-9]
        if not free:
            break
        total = sum(w[s] for s in free)
        add = {s: min(left * w[s] / total, cap[s] - t[s]) for s in free}
        for s in free:
            t[s] += add[s]
        left -= sum(add.values())
    return t


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "b", "c", None])) for i in range(300)] + [(900, None, "a"), (901, "", "z")] + [(7, "x y", "b")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_words=64).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = expected_targets(sizes)
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), block_words=64).collect()), key=str)
    goals = mixing.targets(mixing.sized(df))
    order = [r.source for r in mixing.schedule(goals, 64).orderBy("slot").collect()]
    half = collections.Counter(order[: len(order) // 2])
    assert all(abs(half[s] - n / 2) <= 3 for s, n in collections.Counter(order).items())


def test_mix_follows_its_slots(spark):
    """A document's first slot is one of its source's slots; in their order, words come as the targets say at every tenth of the mix."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    goals = mixing.targets(mixing.sized(docs)).collect()
    slots = {r.slot: r.source for r in mixing.schedule(spark.createDataFrame(goals), 256).collect()}
    got = mixing.mix(docs, block_words=256).collect()
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)
    assert all(slots[r.first_slot] == r.source for r in got if r.taken)
    order, n = [slots[k] for k in sorted(slots)], collections.Counter(slots.values())
    for cut in range(1, 10):
        head = collections.Counter(order[: len(order) * cut // 10])
        assert all(abs(head[s] - n[s] * cut / 10) <= 4 for s in n)


def test_repeats_of_a_source_of_one_document(spark):
    """A target under half of the only document still takes it; texts without words stay."""
    rows = [(1, " ".join(["w"] * 4000), "b"), *[(10 + i, "x y z", "a") for i in range(100)], (200, "", "a"), (201, None, "b")]
    got = collections.Counter(r.doc_id for r in mixing.repeat_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got[1] >= 1 and got[200] == got[201] == 1


def test_mix_odd_rows(spark, odd, none):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.repeat_documents(odd).columns == odd.columns


# -- 10

def cut_by_hand(rows):
    first, out = {}, []
    key = lambda r: (r[0] is None, r[0] or 0)
    for i, t in rows:
        b = text_of(t).encode()
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            if g not in first or key((i,)) < key((first[g],)):
                first[g] = i
    for i, t in rows:
        b = text_of(t).encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if key((first[b[k : k + 50]],)) < key((i,)):
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def digest_rows(df):
    rows, cut = suffix_dedup.removed_bytes(df)
    cut = cut.select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("k"))
    out = []
    for r in rows.join(cut, "digest", "left").collect():
        copy = r.id > r.first_id and r.n_bytes >= 50
        out.append((r.doc_id, r.n_bytes if copy else r.n_removed or 0, 1 if copy else r.n_spans or 0, hashlib.sha256(b"").hexdigest() if copy else r.k or bytes(r.digest).hex()))
    return out


def test_suffix_dedup_against_all_windows(spark, odd, none):
    rng = random.Random(12)
    passages = [prose(rng, 20) for _ in range(5)] + ["ab" * 60, "x" * 200]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(12), 10**6)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            parts += [p[rng.randrange(20) :], prose(rng, rng.randrange(6), 10**6)]
        rows.append((i * 7 % 80, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (rows[5][0], rows[6][1])]
    got = digest_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(got) == sorted(cut_by_hand(rows))
    pairs = [r[:2] for r in odd_rows()]
    assert sorted(digest_rows(odd), key=str) == sorted(cut_by_hand(pairs), key=str)
    assert digest_rows(none) == []


def test_equal_hashes_remove_nothing(monkeypatch):
    """Strings count as equal by their bytes, in one piece and across pieces."""
    rng = random.Random(2)
    base = bytes(rng.choices(b"ab\x00", k=80))
    texts = [base, base[:60] + b"z" * 10, bytes(rng.choices(b"ab", k=90)), base[5:75], bytes(rng.choices(b"a\x00", k=70)), base[1:]]
    monkeypatch.setattr(suffix_dedup, "hashes", lambda data, n: np.zeros(len(data) - n + 1, np.uint64))
    ids = [4, 9, 2, 7, 1, 3]
    import pyarrow as pa

    blob = lambda x: np.array([x], np.int64).tobytes()
    table = pa.table({"shard": [0] * 6, "data": texts, "docs": [blob(i) for i in ids], "starts": [blob(0)] * 6, "lens": [blob(len(t)) for t in texts], "texts": [blob(i) for i in ids]})
    want = sorted((i, k) for i, t in zip(ids, texts) for k in range(len(t) - 49) if any(t[k : k + 50] in u for j, u in zip(ids, texts) if j < i))
    for piece in (60, 170, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        out = suffix_dedup._decide(table).to_pylist()
        assert sorted((r["doc"], k) for r in out for k in range(r["first"], r["last"] + 1)) == want and want


def test_hot_owners_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    rng = random.Random(1)
    p = prose(rng, 15)
    rows = [(i, f"{prose(rng, 4, 10**6)} {p} {prose(rng, 3, 10**6)}") for i in range(30)]
    table = suffix_dedup._shared
    import pyarrow as pa

    keys = np.array([5, 5], np.uint32)
    out = table(pa.table({"bucket": pa.array([0], pa.int32()), "known": [False], "owners": [keys.tobytes()], "texts": [np.array([1, 2], np.int64).tobytes()]}))
    assert [len(x) for x in out.column("hot").to_pylist()] == [8, 8]
    assert sorted(digest_rows(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(cut_by_hand(rows))


def test_suffix_array_and_prefixes():
    rng = random.Random(0)
    for _ in range(60):
        data = np.frombuffer(bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(1, 70))), np.uint8)
        b = data.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        order = suffix_dedup.suffix_array(data)
        assert list(order) == want
        lcp = suffix_dedup.common_prefixes(data, order)
        for k in range(1, len(b)):
            x, y = b[want[k - 1] :], b[want[k] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[k] == n


# -- the pipeline

def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = corpus_pipeline.documents(spark, DATA)
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = docs
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert docs.columns == before
        ids = docs.select("doc_id").distinct()
        assert ids.join(seen, "doc_id", "left_anti").count() == 0
        if name == "exact_dedup":
            best = {}
            for r in seen.select("doc_id", "text").collect():
                best[r.text] = max(r.doc_id, best.get(r.text, -1))
            assert sorted(r.doc_id for r in ids.collect()) == sorted(best.values())
        if name == "minhash_dedup":
            want = brute_classes([(r.doc_id, r.text) for r in seen.select("doc_id", "text").collect()])
            assert sorted(r.doc_id for r in ids.collect()) == sorted(set(want.values()))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    texts = collections.Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in docs.select("text").collect())
    assert collections.Counter(r.decoded_sha256 for r in last.collect()) == texts
