"""Byte-level BPE through a sentencepiece model that is written straight from a vocabulary of ranks.

Each byte stands for one printable code point, so a token's bytes make one piece; its score is the negative rank and
normalisation is the identity. sentencepiece then merges as byte-level BPE does: always the pair whose merge has the
lowest rank, the leftmost of equals. A pre-token that is itself in the vocabulary is that token, merged or not.

Defined results: null text counts as empty and has no tokens; repeated rows give repeated results; an empty table gives
an empty result; other columns are not read. Whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE = 200_000
"""Pre-tokens whose ids a task remembers; beyond it the memory is emptied. It changes speed only."""
CACHED_CHARS = 64


def byte_chars() -> list[str]:
    """The printable code point that stands for each byte: itself where printable, else the next from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: <unk>, then a piece per token in order of rank."""
    chars = byte_chars()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("<unk>", 0.0, 2)]
    pieces += [piece("".join(chars[b] for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0)  # model_type BPE, vocab_size, unk_id
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos or pad
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)  # no dummy prefix, nothing removed or escaped
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and ids to bytes, for one vocabulary file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.by_piece = [0, *sorted(self.ranks.values())]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.chars = dict(enumerate(byte_chars()))
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _new(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        found = {w: struct.pack("<I", self.ranks[b]) for w, b in zip(words, raw) if b in self.ranks}
        rest = [(w, b.decode("latin-1").translate(self.chars)) for w, b in zip(words, raw) if w not in found]
        ids = self.model.encode([x for _, x in rest], num_threads=1) if rest else []
        at = self.by_piece
        found.update((w, struct.pack(f"<{len(i)}I", *[at[k] for k in i])) for (w, _), i in zip(rest, ids))
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > CACHE:
            self.known.clear()
        new = self._new([w for w in dict.fromkeys(words) if w not in self.known])
        self.known.update((w, i) for w, i in new.items() if len(w) <= CACHED_CHARS)
        known = self.known
        return b"".join([known[w] if w in known else new[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist() if ids else []))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (binary, uint32 little-endian), decoded (binary). The file must be on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), *tokenizer())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows of docs without their text, and n_tokens, ids (binary, uint32 little-endian), ids_sha256 and decoded_sha256.
    Columns of docs with these names are left out."""
    own = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rest = [c for c in docs.columns if c not in [*own, text_col]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x.as_py()) for x in part.column(0)]
                columns = [
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*rest, *own])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"])
    return docs.select(text_of(text_col).alias("__text"), *rest).mapInArrow(run, schema)
