"""Encoding a corpus with a public byte-level BPE vocabulary.

The vocabulary is a list of byte strings and ranks. It is serialised as a
sentencepiece BPE model: each byte becomes one letter, so a piece is a word over
256 letters, its score is its negative rank, and normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern, each distinct
pre-token is encoded once per batch of work, and ids map back to bytes by the
inverse of the byte table.

Defined results: an empty or null text has no ids. Texts that look like special
tokens are ordinary text. Columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import table

#: Where the vocabulary files lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts texts into pre-tokens (fixed by the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a worker remembers; beyond that it starts anew. Results don't depend on it.
CACHE = 150_000

#: One letter for each byte, none of them white space: U+0100 and up.
LETTERS = [chr(0x100 + b) for b in range(256)]
_TO_LETTERS = dict(enumerate(LETTERS))


def read_ranks(data: bytes) -> list[bytes]:
    """Byte strings in the order of their ids, from a vocabulary file's bytes."""
    rows = (line.split() for line in data.splitlines() if line.strip())
    ranked = sorted((int(r), base64.b64decode(t)) for t, r in rows)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in ranked]


def letters(data: bytes) -> str:
    """Each byte as its letter."""
    return data.decode("latin-1").translate(_TO_LETTERS)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, whole number or float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """A serialised BPE model; piece ``i`` has the model's id ``i + 1``, as 0 is the unknown piece."""
    normal, unknown, bpe = 1, 2, 2
    body = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    body += [_field(1, _field(1, letters(p).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, p in enumerate(pieces)]
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(body) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes with one vocabulary; holds a bounded memory of pre-tokens."""

    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self.pieces = read_ranks(data)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.pieces))
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = [w for w in set(chain.from_iterable(cut)) if w not in known]
        spelled = [letters(w.encode("utf-8", "replace")) for w in new]
        for w, ids in zip(new, self.model.encode(spelled, num_threads=1) if new else []):
            known[w] = [i - 1 for i in ids]
        get = known.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(data: bytes | None = None) -> Encoder:
    """The process's encoder of a vocabulary, given as its file's bytes."""
    data = Path(VOCABULARY).read_bytes() if data is None else data
    key = hashlib.blake2b(data, digest_size=16).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _sent(df: DataFrame, path: str):  # noqa: ANN202
    """The vocabulary file, read on the driver and sent to the workers: under 1 MB, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


#: Characters of text encoded at once, which bounds a worker's memory.
SLICE_CHARS = 400_000


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters each (one long text is a range of its own)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; no shuffle."""
    fields = [df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    held = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                ids = pa.array(enc.encode_batch(texts[i:j]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def count_tokens(df: DataFrame, text_col: str = "text", path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """All columns but the text, and the number of its tokens; no shuffle."""
    keep = [c for c in df.columns if c != text_col]
    fields = [*[df.schema[c] for c in keep], T.StructField(name, T.LongType(), False)]
    held = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for i, j in slices(texts):
                n = pa.array([len(x) for x in enc.encode_batch(texts[i:j])], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, j - i) for k in range(len(keep))], n], [*keep, name])

    return df.select(*keep, text_col).mapInArrow(run, T.StructType(fields))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document by byte_bpe_50k."""
    return encode(table(spark, d, "documents"))


def decode(df: DataFrame, id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``text`` of ids by the inverse mapping; no shuffle. Null ids and no ids give an empty text."""
    held = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again, as a digest."""
    return decode(p7_ids(spark, d)).select("doc_id", F.md5("text").alias("digest"))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded}
SQL = {"p7_decoded": "select doc_id, md5(coalesce(text, '')) as digest from documents"}
