"""Garbled text from wrong character encoding.

1. Pairs of neighbouring characters are counted over the whole text corpus into a
   table of hashed cells, whose number follows from how many are filled, up to a
   bound; a pair's score is its mutual information: how much more often it stands
   together than its characters' frequencies let expect. A pair is known if it makes
   up a least share of the corpus, so that chance hits in a full table don't count.
2. In each record the improbable pairs, those that hold a character beyond ASCII
   and score low, weigh against the probable ones; the maximum-scoring segments of
   that sequence are the suspected runs.
3. Only inside those runs inverse mappings are tested: back to bytes by the
   encoding that was wrongly used, and again to text by another. A mapping holds if
   its result decodes and is more plausible by the table than what it replaces.
   It is repeated for text that was garbled more than once. A replacement
   character, what is left of bytes that no longer exist, is improbable anywhere.

Defined results: null and empty texts are not affected. A record whose original
can't be had back is affected, and its restored text keeps what can't be mapped.
Rows of one id are joined to one (affected if any is). An empty corpus makes all
pairs equally improbable; the mappings decide then. Columns besides id and text
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.textarrays import mix, points_of
from quern.session import table

#: Cells that pairs are counted in, two bytes each. While less than one in ``SPARSE`` of them is filled, a table is folded to half, but not below ``LEAST``.
#: A pair that the corpus lacks may hit a filled cell, so a table must be nearly empty for its verdicts to be sure.
CELLS, LEAST, SPARSE = 1 << 24, 1 << 22, 512
#: Share of the corpus from which on a pair is known (once at least).
KNOWN = 1e-8
#: Characters rarer than this count as this frequent, so that chance pairs of rare ones don't look bound together.
RARE = 1e-3
#: Pairs never seen count as this often.
UNSEEN = 0.05
#: A pair weighs for a run by how far its mutual information lies under this.
BOUND = 0.0
#: What a pair of ASCII characters weighs against a run.
PLAIN = -1.5
#: Counts are kept as logarithms in so many steps each, which two bytes hold for any count.
STEP = 1000.0

#: Encodings that text is wrongly read in: one byte a character (fixed names).
SINGLE = ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "iso8859_15", "koi8_r", "cp866"]
#: Encodings of several bytes a character that text is wrongly read in.
MULTI = ["gb18030", "big5", "shift_jis", "euc_kr"]
#: Encodings of several bytes that texts may have been written in besides UTF-8.
WRITTEN = ["gb18030", "big5", "shift_jis"]
#: One-byte encodings mixed up with each other: wrongly read in, written in.
MIXED = [("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1251", "cp1252")]

LOST = "�"
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CONTROLS = re.compile("[\u0080-\u0084\u0086-\u009f]")


def _bytes_of(codec: str) -> dict[int, int]:
    """Character to byte; bytes without a character stand for themselves, as browsers read them."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


_TO_BYTE = {c: _bytes_of(c) for c in SINGLE}


def cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The table's cell of each pair; a character alone is a pair with 0."""
    return (mix(a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) & np.uint64(CELLS - 1)).astype(np.int64)


class PairTable:
    """Counts of pairs and characters as logarithms; the number of cells is a power of two."""

    def __init__(self, logs: np.ndarray, total: float) -> None:
        self.logs, self.total = logs, max(total, 1.0)
        self.least = 1 + STEP * np.log(max(1.0, KNOWN * self.total))
        #: Verdicts by this table on runs with their neighbours.
        self.memo: dict[tuple[str, str, str], str | None] = {}

    def _at(self, cell: np.ndarray) -> np.ndarray:
        return self.logs[cell & (len(self.logs) - 1)]

    def log_count(self, cell: np.ndarray) -> np.ndarray:
        v = self._at(cell).astype(np.float32)
        return np.where(v > 0, (v - 1) / STEP, np.log(UNSEEN))

    def information(self, x: np.ndarray) -> np.ndarray:
        """The mutual information of each character with the next."""
        alone = np.maximum(self.log_count(cells(x, np.zeros_like(x))), np.log(RARE * self.total))
        return self.log_count(cells(x[:-1], x[1:])) + np.log(self.total) - alone[:-1] - alone[1:]

    def seen(self, text: str) -> float:
        """The share of pairs with a character beyond ASCII that are known from the corpus."""
        x = points_of(text)
        if len(x) < 2:
            return 0.0
        far = (x[:-1] > 127) | (x[1:] > 127)
        return float((self._at(cells(x[:-1], x[1:])[far]) >= self.least).mean()) if far.any() else 0.0


def segments(weights: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments ``[i, j)`` of a sequence, in order, in linear time.

    Neighbours of equal sign are added up first, so the work is in proportion to
    the changes of sign.
    """
    if not len(weights) or not (weights > 0).any():
        return []
    sign = weights > 0
    start = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    sums, ends = np.add.reduceat(weights, start), np.append(start[1:], len(weights))
    stack: list[list[float]] = []  # first, end, total before, total after
    total = 0.0
    for i, j, s in zip(start.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        new = [i, j, total, total + s]
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k -= 1
            if k < 0 or stack[k][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
    return [(int(a), int(b)) for a, b, _, _ in stack]


def suspects(text: str, pairs: PairTable) -> list[tuple[int, int]]:
    """Runs of characters that are improbable next to each other."""
    x = points_of(text)
    if len(x) < 2 or not (x > 127).any():
        return [(0, 1)] if text == LOST else []
    far = (x[:-1] > 127) | (x[1:] > 127)
    weights = np.full(len(x) - 1, PLAIN, np.float32)
    at = np.flatnonzero(far)
    near = np.unique(np.concatenate([at, at + 1]))
    alone = np.zeros(len(x), np.float32)
    alone[near] = np.maximum(pairs.log_count(cells(x[near], np.zeros_like(x[near]))), np.log(RARE * pairs.total))
    both = pairs.log_count(cells(x[at], x[at + 1])) + np.log(pairs.total)
    weights[at] = BOUND - (both - alone[at] - alone[at + 1])
    lost = (x[:-1] == ord(LOST)) | (x[1:] == ord(LOST))
    weights[lost] = np.maximum(weights[lost], 1.0)
    out = []
    for i, j in segments(weights):
        j += 1
        while i < j and x[i] < 128:
            i += 1
        if i < j:
            out.append((i, j))
    return out


def _utf8(data: bytes) -> str | None:
    """Bytes read as UTF-8, if some of them and all beyond ASCII are that."""
    high = sum(b > 127 for b in data)
    if not high or sum(len(m) for m in _SEQUENCE.findall(data)) < high:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _everyday(text: str) -> float:
    """The share of the characters beyond ASCII that are everyday Chinese: of the standard's first level or its punctuation."""
    far = [c for c in text if c > "\x7f"]
    good = 0
    for c in far:
        try:
            raw = c.encode("gb2312")
        except UnicodeEncodeError:
            continue
        good += len(raw) == 2 and (0xB0 <= raw[0] <= 0xD7 or 0xA1 <= raw[0] <= 0xA3)
    return good / len(far) if far else 0.0


def invert(run: str, pairs: PairTable, left: str = "", right: str = "") -> str | None:
    """The original of a run, if some inverse mapping gives one that is more plausible between its neighbours.

    Bytes of single-byte encodings that happen to be UTF-8 are proof. All others
    must give pairs that the corpus has, or everyday characters where there were
    rare ones.
    """
    best, best_got = None, 0.0
    before = pairs.seen(left + run + right)
    codes = [ord(c) for c in run]

    def offer(text: str | None, least: float, bonus: float = 0.0) -> None:
        nonlocal best, best_got
        if text is not None and text != run:
            got = pairs.seen(left + text + right)
            if got >= least and got + bonus > best_got:
                best, best_got = text, got + bonus

    def written(raw: bytes, codecs: list[str]) -> None:
        for codec in codecs:
            try:
                text = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            high = sum(b > 127 for b in raw)
            if high >= 6 and high >= 0.6 * len(raw) and before < 0.2 and codec == "gb18030" and _everyday(text) >= 0.9 and _everyday(run) < 0.6:
                offer(text, 0.0, 0.3)
            else:
                offer(text, max(0.4, before + 0.3))

    raws = []
    for codec in SINGLE:
        data = [_TO_BYTE[codec].get(c) for c in codes]
        if None not in data:
            raw = bytes(data)  # type: ignore[arg-type]
            offer(_utf8(raw), 0.0, 2.0)
            raws.append(raw)
    if best is not None:
        return best
    if len(run) >= 4:
        for raw in raws:
            written(raw, WRITTEN)
    if _CONTROLS.search(run):
        try:
            text = run.encode("latin-1").decode("cp1252")
            if not _CONTROLS.search(text):
                return best or text
        except UnicodeError:
            pass
    for codec in MULTI:
        try:
            raw = run.encode(codec)
        except UnicodeEncodeError:
            continue
        text = _utf8(raw)
        if text is not None and len(raw) >= 6 and len(text) * 3 == len(raw) and before < 0.5 and _everyday(text) >= 0.9:
            offer(text, 0.0, 1.0)
        else:
            offer(text, max(0.4, before + 0.25), 1.0)
        if len(run) >= 3:
            written(raw, [w for w in WRITTEN if w != codec and (codec != "gb18030" or w == "big5")])
    if best is None and before <= 0.2:
        # Any byte is a character here, so all pairs of the result must be known.
        for read, was in MIXED:
            data = [_TO_BYTE[read].get(c) for c in codes]
            if None not in data:
                text = bytes(data).decode(was, "replace")  # type: ignore[arg-type]
                # A capital that begins a word is natural, whatever letter it could be instead.
                changed = [(a, b, c) for a, b, c in zip(left[-1:].rjust(1) + run, run, text) if b != c]
                if not all(b.isupper() and c.isalpha() and not a.isalpha() for a, b, c in changed):
                    offer(text, 0.95)
    return best


def _pieces(run: str) -> Iterator[tuple[int, int]]:
    """Stretches of a run between lost characters and plain white space."""
    for m in re.finditer(r"[^\s�](?:[^\r\n�]*[^\s�])?", run):
        yield m.span()


def _remembered(run: str, pairs: PairTable, left: str, right: str) -> str | None:
    """``invert``, but runs that come again, as site furniture does, are tested once."""
    key = (left, run, right)
    if key not in pairs.memo:
        if len(pairs.memo) > 50_000:
            pairs.memo.clear()
        pairs.memo[key] = invert(run, pairs, left, right)
    return pairs.memo[key]


def repair(text: str | None, pairs: PairTable) -> tuple[bool, str | None]:
    """Whether a text is affected, and the text with all that can be mapped back."""
    if not text:
        return False, text
    affected = False
    for _ in range(4):
        out, done, changed = [], 0, False
        for i, j in suspects(text, pairs):
            affected |= LOST in text[i:j]
            for a, b in _pieces(text[i:j]):
                for lo, hi in _trials(text, i + a, i + b):
                    got = _remembered(text[lo:hi], pairs, text[max(0, lo - 1) : lo], text[hi : hi + 1])
                    if got is not None:
                        if lo >= done:
                            out += [text[done:lo], got]
                            done, changed = hi, True
                        break
        if not changed:
            break
        affected = True
        text = "".join(out) + text[done:]
    return affected, text


def _trials(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The run itself, without plain ends, with the characters beyond ASCII next to it, and its parts beyond ASCII."""
    tried = set()

    def new(a: int, b: int) -> Iterator[tuple[int, int]]:
        if a < b and (a, b) not in tried:
            tried.add((a, b))
            yield a, b

    yield from new(lo, hi)
    a, b = lo, hi
    while b > a and text[b - 1] < "\x80":
        b -= 1
    yield from new(a, b)
    c, d = a, b
    while c > 0 and "\x80" <= text[c - 1] != LOST:
        c -= 1
    while d < len(text) and "\x80" <= text[d] != LOST:
        d += 1
    yield from new(c, d)
    for m in re.finditer(r"[^\x00-\x7f�]+", text[c:d]):
        yield from new(c + m.start(), c + m.end())


def pair_table(corpus: DataFrame, text_col: str = "text") -> PairTable:
    """Count pairs over all texts. Tasks add up their own counts first; the driver gets the table, whose size is bounded by its cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held)
            cell = np.concatenate([cells(x[:-1], x[1:])[(x[:-1] != 0) & (x[1:] != 0)], cells(x, np.zeros_like(x))[x != 0]])
            u, n = np.unique(cell.astype(np.int32), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n, pa.int64())], ["cell", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held += [points_of(t), np.zeros(1, np.uint32)]
                    size += len(t)
                    if size > 4_000_000:
                        yield flush()
                        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([size], pa.int64())], ["cell", "n"])
                        held, size = [], 0
        if held:
            yield flush()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([size], pa.int64())], ["cell", "n"])

    per_cell = corpus.select(text_col).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf.block.iloc[0])
        logs = np.zeros(1 << 16, np.uint16)
        if block >= 0:
            logs[pdf.cell.to_numpy() & 0xFFFF] = _logs(pdf.n.to_numpy())
        return pd.DataFrame({"block": [block], "logs": [zlib.compress(logs.tobytes(), 1)], "n": [int(pdf.n.sum())], "cells": [len(pdf)]})

    logs, total, full = np.zeros(CELLS, np.uint16), 0, 0
    packed = per_cell.withColumn("block", F.expr("if(cell < 0, -1, cell div 65536)").cast("long")).groupBy("block").applyInPandas(pack, "block long, logs binary, n long, cells long")
    for r in packed.collect():
        if r.block < 0:
            total = r.n
        else:
            logs[r.block << 16 : r.block + 1 << 16] = np.frombuffer(zlib.decompress(r.logs), np.uint16)
            full += r.cells
    while len(logs) > LEAST and full * SPARSE < len(logs):
        half = len(logs) // 2
        both = np.logaddexp(*[np.where(x > 0, (x - 1.0) / STEP, -np.inf) for x in (logs[:half], logs[half:])])
        logs = np.where(np.isfinite(both), 1 + np.rint(both * STEP), 0).astype(np.uint16)
    return PairTable(logs, total)


def _logs(n: np.ndarray) -> np.ndarray:
    return (1 + np.rint(np.log(n) * STEP)).astype(np.uint16)


def find_garbled(records: DataFrame, pairs: PairTable, garbled_only: bool = True) -> DataFrame:
    """Affected records of ``records`` (any columns, the last being the text): those columns, ``affected`` and ``restored``.

    Texts of ASCII alone never reach Python. No shuffle.
    """
    *keep, text = records.columns
    held = records.sparkSession.sparkContext.broadcast((pairs.logs, pairs.total))
    fields = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in records.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PairTable(*held.value)
        for b in batches:
            got = [repair(t, own) for t in b.column(len(keep)).to_pylist()]
            at = pa.array([i for i, (bad, _) in enumerate(got) if bad or not garbled_only], pa.int64())
            kept = b.take(at)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([got[i][0] for i in at.to_pylist()], pa.bool_()), pa.array([got[i][1] for i in at.to_pylist()], pa.string())], [*keep, text, "affected", "restored"])

    some = records.where(F.col(text).rlike(r"[^\x00-\x7f]")) if garbled_only else records
    return some.mapInArrow(run, f"{fields}, affected boolean, restored string")


def _records(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), F.col("title").alias("text"))
    pages = table(spark, d, "conversion_results").select(F.lit("conversion_results").alias("src_table"), F.col("conv_id").alias("row_id"), F.col("markdown").alias("text"))
    return titles.unionByName(pages)


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(_records(spark, d), pair_table(table(spark, d, "documents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles and conversions with text from a wrong encoding."""
    return _garbled(spark, d).select("src_table", "row_id").distinct()


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected rows with what could be restored; ``complete`` unless characters are lost for good."""
    return _garbled(spark, d).select("src_table", "row_id", "restored", (~F.col("restored").contains(LOST)).alias("complete")).distinct()


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
