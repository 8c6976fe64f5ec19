"""Collocations against a brute force in Python."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, source string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, covered=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    big = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, p), a in big.items():
        if any(100 * b >= covered * a for (m, q), b in big.items() if m == lang and len(q) > len(p) and (q[:-1] == p or q[1:] == p)):
            continue
        s, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])]


def texts(rng, n, words=12, length=60):
    names = [rng.choice("aAbBéß") + rng.choice("xyzÄ") * rng.randrange(3) for _ in range(words)]
    signs = [" ", " ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!", " \r\n "]
    return ["".join(rng.choice(names) + rng.choice(signs) for _ in range(rng.randrange(length))) for _ in range(n)]


def odd(rng):
    t = texts(rng, 400)
    rows = [(i, x, ("en", "de", None, "und")[i % 4], "s") for i, x in enumerate(t)]
    rows += [(100, None, "en", "s"), (101, "", "fr", "s"), (102, " .\t.", "xx", "s"), (103, "a b c \x00 \x01x\x1cy a b c", "en", None)]
    rows += [(104, "hot word " * 4000, "en", "s"), (104, "hot word " * 4000, "en", "s"), (105, "same line\n" * 30, "de", None)]
    return rows


def test_brute(spark):
    rows = odd(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("k", "n", "f", "phrase", "rank", "part", "_part")}).repartition(3)
    got = [tuple(r) for r in C.collocations(df, top=30).collect()]
    assert len(got) > 60 and sorted(got) == sorted(brute(rows, top=30))
    assert C.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense, size", [(1 << 21, 2_000_000), (1, 300), (1 << 21, 1)])
def test_counts_of_a_task(monkeypatch, dense, size):
    monkeypatch.setattr(C, "DENSE", dense)
    monkeypatch.setattr(C, "TOKENS", size)
    rows = [(x or "", lang or "und") for _, x, lang, _ in odd(random.Random(dense))]
    got, where = collections.Counter(), {}
    for f in range(0, len(rows), 25):
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[f : f + 25]]), pa.array([x for _, x in rows[f : f + 25]])], names=["text", "lang"])
        for b in C._count(5)(iter([batch])):
            for r in b.to_pylist():
                for x in pa.ipc.open_stream(r["block"]).read_all().to_pylist():
                    got[r["lang"], x["phrase"].decode()] += x["n"]
                    bucket = where.setdefault(x["phrase"], r["bucket"])
                    assert bucket == r["bucket"]
    want = collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == +want


def test_ranges_that_cut_a_prefix(spark):
    """One first word, and one last word, of so many phrases that several ranges hold them."""
    rng = random.Random(7)
    tails = [f"t{k}" for k in range(150)]
    rows = [(i, f"hot {t} mid. {t} mid hot, hot word {t}", "en", "s") for i, t in enumerate(tails * 10 + rng.sample(tails, 40))]
    got = [tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) > 300 and sorted(got) == sorted(brute(rows))


def test_products_past_64_bits(spark):
    n = 3_000_000_000
    rows = [("en", 1, "a", n), ("en", 1, "b", n + 1), ("en", 2, "a b", n - 7), ("en", 1, "c", n), ("en", 2, "b c", n // 2), ("en", 3, "a b c", n // 2 - 1000)]
    got = {r.phrase: tuple(r) for r in C.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).collect()}
    a = n // 2 - 1000
    cuts = [(1_000_000 * a * a // (n * (n // 2)), n, n // 2), (1_000_000 * a * a // ((n - 7) * n), n - 7, n)]
    s, l, r = min(cuts, key=lambda x: x[0])
    assert got["a b c"] == ("en", "a b c", a, l, r, s)
    assert got["a b"] == ("en", "a b", n - 7, n, n + 1, 1_000_000 * (n - 7) ** 2 // (n * (n + 1)))
    assert "b c" not in got
