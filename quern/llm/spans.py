"""Long exact spans shared between records.

1. *Anchors.* Every window of ``SPAN`` characters picks the ``GRAM``-character
   string in it with the least hash. Equal windows pick the same string, so two
   records that share a span share an anchor for each of its windows. A record
   has about one anchor in ``SPAN - GRAM`` / 2 characters.
2. Anchors found in one record only are dropped by a count with map-side combine.
3. *Shards.* The windows of each remaining anchor, a stretch of at most
   ``2 * SPAN - GRAM`` characters, go to the shard of their anchor's hash. Equal
   stretches are combined on the way, so a passage copied into any number of
   records enters its shard once. An anchor with more than ``HEAVY`` different
   stretches is divided by where it lies in the window and by the characters that
   all such windows hold, again and again while a part is too heavy; at the last, a
   part's windows are all the same one. So no shard grows with the data.
4. Each shard builds a compressed FM-index of its stretches and streams them
   through it by backward search, which gives how far each window matches;
   windows that occur whole under another record are the result, exactly.

Only parts of records that share an anchor are indexed and searched: streaming
every record through the index of every shard would grow with the square.

Defined results: characters are code points as stored. Null texts and texts
shorter than a span have none. Repeats inside one record don't count. Rows of
one ``doc_id`` are one record. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.fmindex import ORDER, FMIndex
from quern.llm.textarrays import gram_hashes, points_of, rolling_min
from quern.operators.skew import lookup, merged
from quern.session import cpu_tasks, table, write_once

#: Characters a shared span has at least, unless a length is given; an anchor has half of them.
SPAN = 200
#: Different stretches that a shard takes of one anchor; anchors with more are divided first.
HEAVY = 4000
#: Characters of a shard's index.
SHARD_CHARS = 600_000
#: Characters hashed at once; longer texts are hashed in parts that overlap by a span.
PART = 1 << 19


def anchors_in(text: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hash, place, first, last`` of each anchor: it is picked by the windows that start from ``first`` to ``last``."""
    if len(text) < span:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(text, span // 2)
    # The place fills the low bits: of equal hashes the leftmost counts, and the minimum tells where it is.
    low = np.uint64((1 << 20) - 1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    picked = (rolling_min(keyed, span - span // 2 + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    last = np.concatenate([first[1:], [len(picked)]]) - 1
    return h[picked[first]].view(np.int64), picked[first], first, last


def _anchors(docs: DataFrame, span: int) -> DataFrame:
    """``doc_id, h, place, first, last`` of all anchors; ``place`` is where the anchor stands in its first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, places, firsts, lasts = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if doc is None or text is None or len(text) < span:
                    continue
                points = points_of(text)
                for at in range(0, len(points) - span + 1, PART):
                    h, place, first, last = anchors_in(points[at : at + PART + span - 1], span)
                    ids.append(np.full(len(h), doc, np.int64))
                    hashes.append(h)
                    places.append(place - first)
                    firsts.append(first + at)
                    lasts.append(last + at)
            if ids:
                small = [pa.array(np.concatenate(x).astype(np.int32)) for x in (places, firsts, lasts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes)), *small], ["doc_id", "h", "place", "first", "last"])

    return docs.mapInArrow(run, "doc_id long, h long, place int, first int, last int")


def _searched(parts: DataFrame, span: int) -> DataFrame:
    """Shared windows ``stretch_id, from_w, to_w`` of rows ``part, owner, stretch_id, piece, from_w``, found among the rows of their part."""
    names = ["stretch_id", "from_w", "to_w"]

    def flush(rows: list[tuple[int, int, int, str, int]]) -> pa.RecordBatch:
        index = FMIndex([points_of(r[3]) for r in rows], np.array([r[1] for r in rows], np.int64), max(span, ORDER))
        seg, first, last = index.shared_windows(span)
        ids, base = np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[seg]), pa.array((first + base[seg]).astype(np.int32)), pa.array((last + base[seg]).astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, str, int]] = []
        size = 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if size > SHARD_CHARS and held[-1][0] != row[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    rows = parts.select("part", "owner", "stretch_id", "piece", "from_w").repartition(cpu_tasks(parts.sparkSession), "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "stretch_id long, from_w int, to_w int")


def _windows(owned: DataFrame, span: int) -> DataFrame:
    """Shared windows ``stretch_id, from_w, to_w`` of stretches ``h, stretch_id, owner, stretch, place``.

    A part takes the windows in which the anchor's offset lies in ``lo .. hi``; all
    of them hold the characters from ``lo`` before the anchor to ``span - hi``
    behind its start, which name the part. Heavy parts have their offsets halved.
    """
    todo = owned.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(span - span // 2)).withColumn("part", F.col("h")).withColumn("from_w", F.lit(0)).withColumn("piece", F.col("stretch"))
    done = []
    for _ in range((span - span // 2).bit_length() + 1):
        heavy = write_once(todo.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HEAVY).select("part"), "heavy")
        if heavy.isEmpty():
            break
        done.append(_searched(merged(todo, heavy, "part", "left_anti"), span))
        rest = merged(todo, heavy, "part", "left_semi")
        last = rest.where("lo = hi")
        # All windows of such a part are the same.
        owners = last.groupBy("part").agg(F.min("owner").alias("_a"), F.max("owner").alias("_b"), F.count(F.lit(1)).alias("_refs"))
        many = owners.select("part", "_refs", ((F.col("_a") < F.col("_b")) | (F.col("_a") == FMIndex.MANY)).alias("_many"))
        done.append(lookup(last.select("part", "stretch_id", "from_w"), many, "part").where("_many").select("stretch_id", "from_w", F.col("from_w").alias("to_w")))
        mid = F.expr("(lo + hi) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))).alias("o")
        cut = rest.where("lo < hi").select("h", "stretch_id", "owner", "stretch", "place", halves).select("h", "stretch_id", "owner", "stretch", "place", "o.lo", "o.hi")
        cut = cut.withColumn("from_w", F.greatest(F.col("place") - F.col("hi"), F.lit(0))).withColumn("_to", F.least(F.col("place") - F.col("lo"), F.length("stretch") - span)).where("from_w <= _to")
        core = F.expr(f"substring(stretch, place - lo + 1, {span} - hi + lo)")
        piece = F.expr(f"substring(stretch, from_w + 1, _to - from_w + {span})")
        todo = write_once(cut.withColumn("part", F.xxhash64("h", "lo", "hi", core)).withColumn("piece", piece).drop("_to"), "divided")
    else:
        return _union(done)
    return _union([*done, _searched(todo, span)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Maximal shared stretches of every record: ``doc_id, start_char, end_char`` (from 0, end excluded).

    Each is at least ``span`` long (from 2 to some 500,000), and each window of
    ``span`` characters in it stands in another record as well; neighbouring and
    overlapping ones are one.
    """
    if not 2 <= span < PART:
        raise ValueError(f"a span has from 2 to {PART - 1} characters")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    anchors = write_once(_anchors(docs, span), "anchors")
    several = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("_refs"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b")
    several = write_once(several.select("h", "_refs", F.lit(True).alias("several")), "several")
    hits = lookup(anchors, several, "h").where("several")
    per_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("h", "place", "first", "last")).alias("a"))  # bounded by the record's length
    stretch = f"transform(a, x -> struct(x.h as h, x.place as place, x.first as first, substring(text, x.first + 1, x.last - x.first + {span}) as stretch))"
    cut = merged(docs, per_doc, "doc_id").select("doc_id", F.explode(F.expr(stretch)).alias("s")).select("doc_id", "s.*")
    stretches = write_once(cut.withColumn("stretch_id", F.xxhash64("h", "stretch")), "stretches")
    distinct = stretches.groupBy("h", "stretch_id").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count(F.lit(1)).alias("_refs"), F.first("stretch").alias("stretch"), F.min("place").alias("place"))
    owned = write_once(distinct.withColumn("owner", F.when(F.col("_a") < F.col("_b"), F.lit(FMIndex.MANY)).otherwise(F.col("_a"))).drop("_a", "_b"), "owned")
    windows = _windows(owned.drop("_refs"), span).groupBy("stretch_id").agg(F.collect_set(F.struct("from_w", "to_w")).alias("w"))  # bounded by the stretch's length
    facts = write_once(merged(windows, owned.select("stretch_id", "_refs"), "stretch_id"), "facts")
    spans = lookup(stretches.select("doc_id", "first", "stretch_id"), facts, "stretch_id").where("w is not null")
    each = spans.select("doc_id", F.explode("w").alias("w"), "first").select("doc_id", (F.col("first") + F.col("w.from_w")).alias("a"), (F.col("first") + F.col("w.to_w") + span).alias("b"))
    w = W.partitionBy("doc_id").orderBy("a", "b")
    begins = F.when(F.col("a") > F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    runs = each.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "_run").agg(F.min("a").alias("start_char"), F.max("b").alias("end_char")).drop("_run").withColumnRenamed("doc_id", id_col)


def coverage(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Per record: length, characters shared elsewhere, their share and the number of stretches; records without any have 0."""
    per = spans.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return merged(sized, per, "doc_id", "left").select("doc_id", "n_chars", zero("shared_chars"), zero("n_spans")).withColumn("shared_share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Notes that share a span of at least ``SPAN`` characters with another."""
    return shared_spans(table(spark, d, "documents")).select("doc_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared passages of every note."""
    return shared_spans(table(spark, d, "documents"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each note occurs elsewhere."""
    docs = table(spark, d, "documents")
    return coverage(shared_spans(docs), docs)


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_coverage": p9_coverage}
# Every window of the length, by its own text.
_WINDOWS = f"""with w as (select doc_id, i, substring(text, i, {SPAN}) s from documents, unnest(range(1, length(text) - {SPAN} + 2)) r(i) where length(text) >= {SPAN}),
 m as (select md5(s) h from w group by 1 having min(doc_id) < max(doc_id)), f as (select doc_id, i from w join m on md5(s) = h)"""
_SPANS = _WINDOWS + f""", b as (select *, case when i > lag(i) over (partition by doc_id order by i) + {SPAN} then 1 else 0 end new_ from (select distinct * from f)),
 r as (select *, sum(new_) over (partition by doc_id order by i) run from b), spans as (select doc_id, min(i) - 1 as start_char, max(i) - 1 + {SPAN} as end_char from r group by doc_id, run)"""
SQL = {
    "p9_found": _WINDOWS + " select distinct doc_id from f",
    "p9_spans": _SPANS + " select doc_id, start_char, end_char from spans",
    "p9_coverage": _SPANS + """ select d.doc_id, coalesce(length(text), 0) as n_chars, coalesce(c, 0)::bigint as shared_chars, coalesce(n, 0) as n_spans,
 round(coalesce(c::double / nullif(length(text), 0), 0), 6) as shared_share from documents d left join (select doc_id, sum(end_char - start_char) c, count(*) n from spans group by 1) s using (doc_id)""",
}
