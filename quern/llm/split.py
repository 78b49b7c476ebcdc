"""Splitting oversized items at natural boundaries.

Recursive bisection: a stretch longer than the room is cut at the strongest
boundary near its midpoint, and both halves are treated alike until each fits.
The room is the limit less the overlap, so that the overlap, attached last, never
takes a piece over the limit. The first piece has none. Where the window around the
midpoint has no boundary, the nearest one outside it is taken before a word is cut.

Defined results: lengths are code points. A null or empty item, or one within the
limit, is one piece as it stands (null stays null). A text without any boundary is
cut at its midpoint, but not inside a line-end pair or before a combining mark
where the window offers another place. Repeated rows give repeated pieces. Items
without a limit are not returned. A limit below 1 counts as 1, an overlap above
half the limit as half of it, a null overlap as 0.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import table

#: Boundaries from the strongest to the weakest; a cut falls at the end of a match.
BOUNDARIES = [
    re.compile(r"\n(?=#{1,6} )"),
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile("\r?\n|[\u2028\u2029\x0b\x0c]"),
    re.compile(r"[。！？]+[”’」』）]*|[.!?]+[\"'”’)\]]*(?=\s)\s+"),
    re.compile(r"[；;：:]\s*|[，、]|,(?=\s)\s+"),
    re.compile(r"\s+"),
]
#: A cut lies within this share of the stretch around its midpoint.
NEAR = 0.5

_ZWJ = "\u200d"
_JOINERS = {_ZWJ, "\ufe0e", "\ufe0f"}


def _unbreakable(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part what is read as one character."""
    a, b = text[at - 1], text[at]
    return a == "\r" and b == "\n" or b in _JOINERS or a == _ZWJ or unicodedata.combining(b) != 0 or 0x1F3FB <= ord(b) <= 0x1F3FF


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Where the pieces of ``text`` start; piece ``i`` ends where the next starts."""
    n = len(text)
    if n <= limit:
        return [0]
    room = limit - overlap
    levels = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]

    def best(lo: int, hi: int) -> int:
        mid = (lo + hi) // 2
        reach = max(1, int((hi - lo) * NEAR / 2))
        first, last = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
        for ends in levels:
            k = bisect_left(ends, mid)
            near = [e for e in ends[max(0, k - 1) : k + 1] if first <= e <= last]
            if near:
                return min(near, key=lambda e: (abs(e - mid), e))
        for ends in levels:
            k = bisect_left(ends, mid)
            near = [e for e in ends[max(0, k - 1) : k + 1] if lo < e < hi]
            if near:
                return min(near, key=lambda e: (abs(e - mid), e))
        for step in range(last - first + 1):
            for at in (mid + step, mid - step):
                if first <= at <= last and not _unbreakable(text, at):
                    return at
        return mid

    starts, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit if lo == 0 else room):
            starts.append(lo)
        else:
            at = best(lo, hi)
            todo += [(at, hi), (lo, at)]
    return starts


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Start and end of each piece's own part, and its content with the overlap before it."""
    limit = max(1, limit)
    overlap = max(0, min(overlap or 0, limit // 2))
    starts = cuts(text, limit, overlap)
    ends = [*starts[1:], len(text)]
    return [(s, e, text[max(0, s - overlap) : e]) for s, e in zip(starts, ends)]


def split_items(df: DataFrame) -> DataFrame:
    """Pieces of items.

    ``df`` has ``item_id, content, section_path, max_chars, overlap_chars`` and
    any others, which are ignored. Gives ``item_id, piece_no`` (from 0),
    ``n_pieces, start_char, end_char`` (of the piece's own part), ``content,
    section_path``. Items within their limit stay in the JVM; only oversized ones
    go to Python. No shuffle.
    """
    schema = T.StructType(
        [
            T.StructField("item_id", T.StringType()),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("n_pieces", T.IntegerType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("content", T.StringType()),
            T.StructField("section_path", T.StringType()),
        ]
    )
    arrow = pa.schema([("item_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("content", pa.string()), ("section_path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text, path, limit, overlap in zip(*[c.to_pylist() for c in b.columns]):
                cut = pieces(text, limit, overlap)
                rows += [(item, k, len(cut), s, e, part, path) for k, (s, e, part) in enumerate(cut)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    df = df.select("item_id", "content", "section_path", "max_chars", "overlap_chars").where("max_chars is not null")
    over = F.coalesce(F.length("content") > F.col("max_chars"), F.lit(False))
    whole = df.where(~over).select("item_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.coalesce(F.length("content"), F.lit(0)).alias("end_char"), "content", "section_path")
    return df.where(over).mapInArrow(run, schema).unionByName(whole)


def _items(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """The table's items with its limits, which are one row of a fixed table of two."""
    limits = table(spark, d, "size_limits").where(F.col("item_table") == name).select("max_chars", "overlap_chars")
    return table(spark, d, name).select(F.col(key).alias("item_id"), "content", "section_path").join(F.broadcast(limits))


TABLES = {"parent_blocks": "parent_id", "chunks": "chunk_id"}


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all items of both tables; repeated rows of an item are cut once."""
    parts = [split_items(_items(spark, d, t, k).distinct()).withColumn("src_table", F.lit(t)) for t, k in TABLES.items()]
    return parts[0].unionByName(parts[1])


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Items put together again from their pieces without the overlaps, as a digest, and whether each piece is within its limit."""
    limits = table(spark, d, "size_limits").select(F.col("item_table").alias("src_table"), "max_chars")
    p = p5_pieces(spark, d).join(F.broadcast(limits), "src_table")
    own = F.substring("content", F.length("content") - (F.col("end_char") - F.col("start_char")) + 1, F.col("end_char") - F.col("start_char"))
    # An item repeated under another section path is put together once for each.
    parts = p.groupBy("src_table", "item_id", F.coalesce("section_path", F.lit("")).alias("s")).agg(F.array_sort(F.collect_set(F.struct("piece_no", own.alias("t")))).alias("a"), F.max(F.length("content") > F.col("max_chars")).alias("over"))
    return parts.select("src_table", "item_id", F.md5(F.array_join(F.transform("a", lambda x: x.t), "")).alias("digest"), F.coalesce(~F.col("over"), F.lit(True)).alias("fits")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be split: those with a second piece."""
    parts = [split_items(_items(spark, d, t, k)).where("piece_no = 1").select(F.lit(t).alias("src_table"), "item_id") for t, k in TABLES.items()]
    return parts[0].unionByName(parts[1]).distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt}
SQL = {
    "p5_rebuilt": """select distinct src_table, item_id, md5(coalesce(content, '')) as digest, true as fits from (
 select 'parent_blocks' src_table, parent_id item_id, content from parent_blocks union all select 'chunks', chunk_id, content from chunks)""",
    "p5_found": """
select distinct src_table, item_id from (
 select 'parent_blocks' src_table, parent_id item_id, content from parent_blocks union all select 'chunks', chunk_id, content from chunks) x
 join size_limits l on l.item_table = x.src_table where length(content) > max_chars"""
}
