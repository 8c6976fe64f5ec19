"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts in a document of smaller id.

1. Fingerprints. A string of LENGTH bytes holds LENGTH - GRAM + 1 grams of GRAM bytes; the smallest of their hashes is its owner. Equal strings
   have equal owners. A text's distinct owners, a few per hundred bytes, are gathered by hash, and those of at least two texts are sent back.
2. Shards. Stretches of text whose strings have a shared owner go to a shard by that owner, so equal strings meet in one. Owners of very many stretches
   are split further by the hash of the string itself. Equal stretches are settled where they are read: only that of the smallest id goes on.
3. Each shard is cut into pieces of at most PIECE bytes. A piece gets a suffix array by Larsson-Sadakane refinement and common
   prefixes by Kasai's rule; runs of neighbours with at least LENGTH common bytes are the equal strings of a piece, already in the order of their bytes. The lists of
   pieces are merged by binary search, comparing bytes, and each string has the smallest id of its place in the merged list. Hashes only choose what meets
   where: no byte is removed because two hashes agree.
4. Removed stretches are gathered by document, united, and cut out.

Copies of a whole text need no stretches: one that is not of the smallest id among its copies loses all its bytes, if it has LENGTH.

Defined results: null text counts as empty; null ids come after all others; rows of equal id don't remove each other's bytes; repeated rows
give equal results; texts under LENGTH bytes are left alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of, written

LENGTH, GRAM = 50, 20
GRAMS = LENGTH - GRAM + 1
PIECE = 1 << 20
SHARD = 4 << 20
"""Bytes of a piece, and of a shard, about."""
HOT = 4000
"""Chunks of documents that share an owner, from which on it is split by string."""
CHUNK = 512
LAST = (1 << 63) - 1

_U = np.uint64
_M1, _M2 = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M1 + b) * _M2
    return x ^ (x >> _U(29))


def hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all strings of n bytes, by joining those of shorter ones."""
    size, h = 1, data.astype(np.uint64) * _M2 + _U(1)
    while size * 2 <= n:
        h = _join(h[:-size], h[size:])
        size *= 2
    return h if size == n else _join(h[: len(h) - (n - size)], h[n - size :])


def owners(data: np.ndarray) -> np.ndarray:
    """The owner of each string of LENGTH bytes: the smallest hash of its grams."""
    m, size = hashes(data, GRAM), 1
    while size * 2 <= GRAMS:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == GRAMS else np.minimum(m[: len(m) - (GRAMS - size)], m[GRAMS - size :])


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return first, np.r_[first[1:] - 1, len(x) - 1]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    Ranks of the first h bytes, doubled in each round: only groups that are not single yet are sorted again, by the rank of
    the suffix h places further. A rank is the place of its group's last member, so ranks of finished groups stay.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.r_[data.astype(np.uint64) + _U(1), np.zeros(8, np.uint64)]
    key, h = np.zeros(n, np.uint64), 7
    for i in range(h):  # seven symbols of nine bits
        key = (key << _U(9)) | padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    first, last = runs(sorted_key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(last, last - first + 1)
    while True:
        wide = last > first
        if not wide.any():
            break
        first, last = first[wide], last[wide]
        size = last - first + 1
        group = np.repeat(np.arange(len(first)), size)
        place = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        own = order[place]
        nxt = rank[np.minimum(own + h, n)]
        again = np.argsort(group * (n + 2) + nxt)
        own, nxt = own[again], nxt[again]
        order[place] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        f = np.flatnonzero(new)
        l = np.r_[f[1:] - 1, len(own) - 1]
        rank[own] = np.repeat(place[l], l - f + 1)
        first, last = place[f], place[l]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it (0 for the first).

    Kasai's rule: where the bytes before two neighbours are equal too, the common prefix is one less than that of the suffix one place
    before. So only the other places are compared, eight bytes at a time; the rest follow, in text order, from a running maximum.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    prior = np.maximum(before, 0)
    follows = (before > 0) & (at > 0) & (data[at - 1] == data[prior - 1])
    start = np.flatnonzero(~follows & (before >= 0))
    length, live = np.zeros(n, np.int64), start
    padded = np.r_[data, np.zeros(1, np.uint8)]
    done = np.zeros(len(start), np.int64)
    index = np.arange(len(start))
    while len(live):
        a, b = at[live] + done[index], before[live] + done[index]
        step = np.zeros(len(live), np.int64)
        same = np.ones(len(live), bool)
        for i in range(8):
            same &= (a + i < n) & (b + i < n)
            same &= padded[np.minimum(a + i, n)] == padded[np.minimum(b + i, n)]
            step += same
        done[index] += step
        more = step == 8
        live, index = live[more], index[more]
    length[start] = done
    reach = np.where(~follows, at + length, 0)
    plcp = np.maximum(np.maximum.accumulate(reach) - at, 0)
    plcp[before < 0] = 0
    return plcp[order]


def piece_classes(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct strings at `starts`, in the order of their bytes: a place of each, and the smallest id in docs (an id for each start); and for each start, which one it is."""
    order = suffix_array(data)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(common_prefixes(data, order) < LENGTH)
    own = group[starts]
    low, at = np.full(len(data) + 1, LAST), np.zeros(len(data) + 1, np.int64)
    np.minimum.at(low, own, docs)
    at[own] = starts
    there = np.zeros(len(data) + 1, bool)
    there[own] = True
    some = np.flatnonzero(there)
    return at[some], low[some], (np.cumsum(there) - 1)[own]


class Merged:
    """Strings of several pieces in the order of their bytes, each by a place in the data, with its smallest id."""

    def __init__(self, data: bytes):
        self.words = np.ndarray(len(data), ">u8", data + bytes(64), strides=(1,))  # eight bytes from each place on
        self.at, self.low, self.pieces = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def word(self, places: np.ndarray, k: int) -> np.ndarray:
        w = self.words[places + 8 * k].astype(np.uint64)
        return w >> _U(64 - 8 * (LENGTH - 8 * k)) if LENGTH - 8 * k < 8 else w

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of places, by all LENGTH bytes."""
        out, live = np.zeros(len(x), np.int8), np.arange(len(x))
        for k in range(-(-LENGTH // 8)):
            a, b = self.word(x[live], k), self.word(y[live], k)
            out[live] = np.where(a < b, -1, a > b)
            live = live[a == b]
            if not len(live):
                break
        return out

    def add(self, at: np.ndarray, low: np.ndarray) -> None:
        """Another piece's list. Binary search finds its strings here; the others go in where they belong."""
        first = self.word(self.at, 0)
        own = self.word(at, 0)
        lo, hi = np.searchsorted(first, own, "left"), np.searchsorted(first, own, "right")
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = self.compare(self.at[mid], at[live]) < 0
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        hit = np.zeros(len(at), bool)
        near = np.flatnonzero(lo < len(self.at))
        hit[near] = self.compare(self.at[lo[near]], at[near]) == 0
        np.minimum.at(self.low, lo[hit], low[hit])
        new = ~hit
        shift = np.cumsum(np.bincount(lo[new], minlength=len(self.at) + 1))  # strings that go in before each place
        self.pieces = [x + shift[x] for x in self.pieces]
        # Of the new ones before this one, all go in at its place or before.
        self.pieces.append(np.where(hit, lo + shift[lo], lo + np.cumsum(new) - new))
        self.at, self.low = np.insert(self.at, lo[new], at[new]), np.insert(self.low, lo[new], low[new])

    def least(self, piece: int) -> np.ndarray:
        """Smallest ids of the strings of a piece."""
        return self.low[self.pieces[piece]]


# -- 1: fingerprints

def _prints(buckets: int):
    """(bucket, owners, texts): owners as 32-bit halves in one blob, with the text of each beside it; of an owner of many texts in a
    chunk, two texts go to the bucket, and its chunk's texts get it back at once, as `known` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                seen, keys, texts = set(), [], []
                for tid, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                    if len(raw) >= LENGTH and tid not in seen:
                        seen.add(tid)
                        o = owners(raw)
                        own = np.unique(o[runs(o)[0]])
                        keys.append(own)
                        texts.append(np.full(len(own), tid, np.int64))
                if not keys:
                    continue
                k, t = np.concatenate(keys), np.concatenate(texts)
                by = np.argsort(k, kind="stable")
                k, t = k[by], t[by]
                first, last = runs(k)
                size = last - first + 1
                rank = np.arange(len(k)) - np.repeat(first, size)
                bucket = ((k >> _U(32)) % _U(buckets)).astype(np.int32)
                many = np.repeat(size, size) >= 2
                for known, keep in ((True, many), (False, rank < 2)):
                    kk, tt, bb = k[keep], t[keep], bucket[keep]
                    by = np.lexsort((tt, bb))
                    kk, tt, bb = kk[by], tt[by], bb[by]
                    if len(bb):
                        f, l = runs(bb)
                        low = (kk & _U(0xFFFFFFFF)).astype(np.uint32)
                        yield pa.RecordBatch.from_pydict({
                            "bucket": pa.array(bb[f], pa.int32()), "known": pa.array([known] * len(f)),
                            "owners": pa.array([low[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()), "texts": pa.array([tt[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()),
                        })

    return run


PRINTS = "bucket int, known boolean, owners binary, texts binary"


def _by_text(bucket: int, low: np.ndarray, text: np.ndarray, hot: np.ndarray) -> pa.Table:
    """(text, keys, hot) rows: keys are bucket and half owner in one number."""
    by = np.argsort(text, kind="stable")
    key = (np.int64(bucket) << np.int64(32)) | low[by].astype(np.int64)
    text, hot = text[by], hot[by]
    f, l = runs(text) if len(text) else (text, text)
    return pa.table({
        "text": pa.array(text[f], pa.int64()), "keys": pa.array([key[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()), "hot": pa.array([key[i : j + 1][hot[i : j + 1]].tobytes() for i, j in zip(f, l)], pa.binary()),
    })


def _shared(group: pa.Table) -> pa.Table:
    """Of one bucket: which texts have owners of at least two texts."""
    bucket = group.column("bucket")[0].as_py()
    rows = list(zip(group.column("known").to_pylist(), group.column("owners").to_pylist(), group.column("texts").to_pylist()))
    load = lambda known: (np.concatenate([np.frombuffer(o, np.uint32) for k, o, _ in rows if k == known] or [np.zeros(0, np.uint32)]), np.concatenate([np.frombuffer(t, np.int64) for k, _, t in rows if k == known] or [np.zeros(0, np.int64)]))
    low, text = load(False)
    known_low, known_text = load(True)
    by = np.lexsort((text, low))
    low, text = low[by], text[by]
    f, l = runs(low) if len(low) else (low, low)
    size = l - f + 1
    shared = np.repeat(text[l] != text[f], size) if len(low) else np.zeros(0, bool)
    hot_owner = low[f][size >= 2 * HOT] if len(low) else low
    low, text = np.r_[low[shared], known_low], np.r_[text[shared], known_text]
    pairs = np.unique(np.rec.fromarrays([text, low])) if len(low) else np.rec.fromarrays([text, low])
    low, text = np.asarray(pairs["f1"]), np.asarray(pairs["f0"])
    return _by_text(bucket, low, text, np.isin(low, hot_owner))


# -- 2: stretches

def _stretches(buckets: int, shards: int):
    """Rows for shards (blobs), and removed stretches that are settled at once (shard -1: ids in docs, first and last string in starts and lens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                best: dict[bytes, tuple] = {}
                again, gone = [], []
                for doc, text, keys, hot, tid in zip(part.column(0).to_pylist(), part.column(1), *(part.column(c).to_pylist() for c in (2, 3, 4))):
                    raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                    if len(raw) < LENGTH:
                        continue
                    o = owners(raw)
                    f, l = runs(o)
                    key = (((o[f] >> _U(32)) % _U(buckets)).astype(np.int64) << np.int64(32)) | (o[f] & _U(0xFFFFFFFF)).astype(np.int64)
                    ok = np.isin(key, np.frombuffer(keys, np.int64))
                    is_hot = np.isin(key, np.frombuffer(hot, np.int64))
                    body, strings = raw.tobytes(), hashes(raw, LENGTH) if is_hot.any() else None
                    for i, j, k, h in zip(f[ok].tolist(), l[ok].tolist(), key[ok].tolist(), is_hot[ok].tolist()):
                        for x, y, s in [(x, x, int(strings[x] % _U(shards))) for x in range(i, j + 1)] if h else [(i, j, (k ^ (k >> 32)) % shards)]:
                            b = body[x : y + LENGTH]
                            old = best.get(b)
                            if old is None:
                                best[b] = (s, doc, x, tid)
                            elif old[1] == doc:
                                again.append((s, doc, x, tid, b))
                            elif old[1] < doc:
                                gone.append((doc, tid, x, y))
                            else:  # the earlier row has the larger id
                                best[b] = (s, doc, x, tid)
                                late = [old, *[g for g in again if g[4] == b and g[1] == old[1]]]
                                again = [g for g in again if not (g[4] == b and g[1] == old[1])]
                                gone += [(g[1], g[3], g[2], g[2] + len(b) - LENGTH) for g in late]
                rows = sorted([(*g, b) for b, g in best.items()] + again)
                if rows:
                    s = np.array([r[0] for r in rows])
                    f, l = runs(s)
                    d, x, t, n = (np.array([v(r) for r in rows], np.int64) for v in (lambda r: r[1], lambda r: r[2], lambda r: r[3], lambda r: len(r[4])))
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(s[f], pa.int32()), "data": pa.array([b"".join(r[4] for r in rows[i : j + 1]) for i, j in zip(f, l)], pa.binary()),
                        "docs": pa.array([d[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()), "starts": pa.array([x[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()), "lens": pa.array([n[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()),
                        "texts": pa.array([t[i : j + 1].tobytes() for i, j in zip(f, l)], pa.binary()),
                    })
                if gone:
                    g = np.array(gone, np.int64)
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([-1], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in (("data", b""), ("docs", g[:, 0].tobytes()), ("starts", g[:, 2].tobytes()), ("lens", g[:, 3].tobytes()), ("texts", g[:, 1].tobytes()))})

    return run


STRETCHES = "shard int, data binary, docs binary, starts binary, lens binary, texts binary"
GONE = "doc long, tid long, first long, last long"


# -- 3: shards

def _gone_rows(*columns: np.ndarray) -> dict:
    """A row for each stretch."""
    return {c: pa.array(x, pa.int64()) for c, x in zip(("doc", "tid", "first", "last"), columns)}


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield pa.RecordBatch.from_pydict(_gone_rows(*(np.frombuffer(x, np.int64) for x in row)))


def _pieces(segments: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of segments of at most PIECE bytes, or one segment."""
    first = size = 0
    for i, x in enumerate(segments):
        if size and size + len(x) > PIECE:
            yield first, i
            first, size = i, 0
        size += len(x)
    if segments:
        yield first, len(segments)


def _decide(group: pa.Table) -> pa.Table:
    """Of one shard: the strings that also start in a document of smaller id, as stretches of documents.

    Equal stretches are one segment here, with the smallest id; its strings' answers hold for all of them."""
    known: dict[bytes, int] = {}
    low_doc: list[int] = []
    number, docs, tids, places = [], [], [], []
    for data, *columns in zip(*(group.column(c).to_pylist() for c in ("data", "docs", "texts", "starts", "lens"))):
        doc, tid, place, lens = (np.frombuffer(x, np.int64) for x in columns)
        ends = np.cumsum(lens).tolist()
        own, at = np.empty(len(doc), np.int64), 0
        for i, (end, d) in enumerate(zip(ends, doc.tolist())):
            x = data[at:end]
            at = end
            k = known.setdefault(x, len(low_doc))
            if k == len(low_doc):
                low_doc.append(d)
            elif d < low_doc[k]:
                low_doc[k] = d
            own[i] = k
        number.append(own)
        docs.append(doc)
        tids.append(tid)
        places.append(place)
    segments, low = list(known), np.array(low_doc, np.int64)
    del known
    count = np.array([len(x) for x in segments], np.int64) - LENGTH + 1
    whole = b"".join(segments)
    merged, each, base = Merged(whole), [], 0
    for a, b in _pieces(segments):
        n = count[a:b]
        lens = n + LENGTH - 1
        data = np.frombuffer(whole, np.uint8, int(lens.sum()), base)
        starts = np.arange(n.sum()) + np.repeat((np.cumsum(lens) - lens) - (np.cumsum(n) - n), n)
        at, own_low, which = piece_classes(data, starts, np.repeat(low[a:b], n))
        merged.add(at + base, own_low)
        each.append(which)
        base += len(data)
    least = np.concatenate([merged.least(i)[which] for i, which in enumerate(each)])
    begin = np.cumsum(count) - count
    number, docs, tids, places = (np.concatenate(x) for x in (number, docs, tids, places))
    out = []
    for at in range(0, len(number), 20_000):
        k, doc, tid, place = (x[at : at + 20_000] for x in (number, docs, tids, places))
        n = count[k]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(k)), n)
        hit = np.flatnonzero(least[begin[k][owner] + offset] < doc[owner])
        if len(hit):
            f = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(owner[hit]) != 0)])
            l = np.r_[f[1:] - 1, len(hit) - 1]
            o = owner[hit[f]]
            out.append((doc[o], tid[o], place[o] + offset[hit[f]], place[o] + offset[hit[l]]))
    return pa.table(_gone_rows(*(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4))))


# -- 4: texts

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n_removed, n_spans, kept): first and last hold arrays of string places."""
    for batch in batches:
        rows, removed, spans, kept = [], [], [], []
        for row, text, first, last in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
            f, l = (y.values.to_numpy() for y in (first, last))
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, f, 1)
            np.add.at(edge, l + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows.append(row)
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            kept.append(raw[~gone].tobytes())
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["digest", "n_removed", "n_spans", "kept"])
                rows, removed, spans, kept = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["digest", "n_removed", "n_spans", "kept"])


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, cut): of every row doc_id, digest, n_bytes, first_id (smallest id of its text); and of each text that loses bytes in its
    first document (digest, n_removed, n_spans, kept bytes)."""
    spark = docs.sparkSession
    text = text_of(text_col)
    whole = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "sizes")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(1, total // (2 * SHARD))
    tid = lambda c: F.conv(F.hex(F.substring(c, 1, 8)), 16, -10).cast("long")
    prints = whole.select(tid("digest").alias("tid"), F.col("text").cast("binary")).mapInArrow(_prints(buckets), PRINTS)
    shared = prints.groupBy("bucket").applyInArrow(_shared, "text long, keys binary, hot binary")
    keys = written(shared, "owners")
    n_keys = keys.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    # By text, all its shared owners: at most one for each few bytes of it.
    join = lambda c: F.unhex(F.array_join(F.transform(F.collect_list(c), F.hex), ""))
    keys = keys.groupBy(F.col("text").alias("tid")).agg(join("keys").alias("keys"), join("hot").alias("hot"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("tid", tid("digest"))
    wanted = first.join(keys, "tid").select("digest", "id", "keys", "hot", "tid")
    suspects = whole.join(wanted, ["digest", "id"]).select("id", F.col("text").cast("binary").alias("text"), "keys", "hot", "tid")
    shards = max(1, n_keys * 3 * LENGTH // (2 * SHARD))
    stretches = written(suspects.mapInArrow(_stretches(buckets, shards), STRETCHES), "stretches")
    settled = stretches.where("shard < 0").select("docs", "texts", "starts", "lens").mapInArrow(_settled, GONE)
    decided = stretches.where("shard >= 0").groupBy("shard").applyInArrow(_decide, GONE)
    gone = written(settled.unionByName(decided), "gone")
    gone = gone.groupBy(F.col("doc").alias("id"), "tid").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    spans = first.join(gone, ["id", "tid"])
    cut = whole.join(spans, ["digest", "id"]).select("digest", F.col("text").cast("binary").alias("text"), "first", "last", "id").dropDuplicates(["digest", "id"])
    cut = cut.mapInArrow(_cut, "digest binary, n_removed long, n_spans long, kept binary")
    return rows.join(first.select("digest", F.col("id").alias("first_id")), "digest"), cut


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = removed_bytes(documents(spark, sf_dir))
    cut = cut.select("digest", F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.sha2("kept", 256).alias("k"))
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    return rows.join(cut, "digest", "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("k", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
