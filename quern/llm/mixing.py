"""Mixing sources to target weights.

The documents of a source are laid end to end in a pseudorandom order and their
tokens are packed into blocks of ``BLOCK`` tokens. A mix is a number of slots, one
block each, in output shards of ``SHARD`` slots. The slots of all shards are halved
again and again down to one shard; at each halving a multinomial draw over what the
sources have to give tells how many of its slots each gets on either side, so the
sums over all shards are the targets exactly. The draws of a halving have a seed of
their own, so a task finds those of its shards by itself, and nothing about shards
passes through the driver. A source's slots are counted through; slot ``j`` takes
block ``permute(j mod blocks)`` of pass ``j div blocks``, and blocks are joined by
that index. A block is used once per pass, and there are at most ``max_repeats``
passes, so no token of a document is used more often than that.

Sources are compared lower-cased, without outer spaces and with ``_`` for ``-``.
Documents without a source, or of sources a mix doesn't name, are not in that mix
but count in the size of all. A source that is named but has no tokens gets
nothing. What a source can't give within its repeats goes to the others in
proportion to their targets; if all are used up, the mix is smaller than asked.
Null, empty and blank texts have their own tokens or none and need no case apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.tokenizer import VOCABULARY, count_tokens, encode, read_ranks
from quern.operators.skew import merged
from quern.session import table, write_once

#: Tokens in a block. Shares are met to within one block per source.
BLOCK = 1024
#: Slots in an output shard.
SHARD = 256
#: Shards that a task draws at once.
GROUP = 64
#: Parts of a source whose sizes are added up apart before documents are laid end to end.
CELLS = 1024
SEED = 20240607


def norm_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def key_of(*parts: object) -> int:
    """A 64-bit key from names; the same on every machine."""
    return int.from_bytes(hashlib.blake2b(repr((SEED, *parts)).encode(), digest_size=8).digest(), "little")


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)``: a Feistel network walked until it lands in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(key_of("round", key, r)) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in rounds:
            mixed = (right + r) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & mask
        return left << np.uint64(half) | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def allot(budget: float, shares: dict[str, float], most: dict[str, int]) -> dict[str, int]:
    """Slots per source: in proportion to the shares, none above its most, until the budget or all sources are used up."""
    got = dict.fromkeys(shares, 0.0)
    open_ = {s for s in shares if most.get(s, 0) > 0 and shares[s] > 0}
    left = budget
    while open_ and left > 1e-9:
        unit = min(left / sum(shares[s] for s in open_), min((most[s] - got[s]) / shares[s] for s in open_))
        for s in open_:
            got[s] += unit * shares[s]
            left -= unit * shares[s]
        open_ = {s for s in open_ if most[s] - got[s] > 1e-9}
    return {s: min(int(round(x)), most.get(s, 0)) for s, x in got.items()}


def draw(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``size`` slots each source gets, none more than it has left."""
    got = np.minimum(rng.multinomial(size, left / left.sum()), left)
    for k in np.argsort(-(left - got), kind="stable"):  # what a source no longer has goes to those with most left
        got[k] += min(size - got.sum(), left[k] - got[k])
    return got


def draw_shards(totals: dict[str, int], key: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, str, int, int]]:
    """Per shard and source: its slots of the source, from which one of the source's slots on; for shards from ``first`` up to ``last``.

    Only the halvings on the way to these shards are drawn, whatever the number of all.
    """
    names = sorted(s for s in totals if totals[s])
    whole = np.array([totals[s] for s in names], np.int64)
    n = int(whole.sum())
    shards = -(-n // SHARD)
    last = shards if last is None else min(last, shards)
    todo = [(0, shards, whole, np.zeros_like(whole))] if first < last else []
    while todo:
        lo, hi, own, before = todo.pop()
        if hi - lo == 1:
            yield from ((lo, s, int(a), int(k)) for s, a, k in zip(names, before, own) if k)
            continue
        mid = (lo + hi) // 2
        left = draw(own, (mid - lo) * SHARD, np.random.default_rng([key, lo, hi]))
        if mid < last and hi > first:
            todo.append((mid, hi, own - left, before + left))
        if mid > first:
            todo.append((lo, mid, left, before))


def lay_out(sized: DataFrame) -> DataFrame:
    """Documents of each source end to end: ``source, doc_id, n_tokens, first_token``.

    A running sum over all of a source would be one task, so sums are taken over
    ``CELLS`` hashed parts of each source first, and then within each part.
    """
    h = sized.withColumn("_h", F.xxhash64(F.lit(SEED), F.col("doc_id"))).withColumn("_cell", F.pmod(F.col("_h"), F.lit(CELLS)))
    per_cell = h.groupBy("source", "_cell").agg(F.sum("n_tokens").alias("_n"))
    before = W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = per_cell.select("source", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("source", "_cell").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    laid = h.join(starts, ["source", "_cell"]).withColumn("first_token", F.col("_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return laid.select("source", "doc_id", "n_tokens", "first_token")


def in_blocks(laid: DataFrame, *more: str) -> DataFrame:
    """The part of each document in each block: ``source, block, doc_id, n_tokens, part`` and columns asked for."""
    end = F.col("first_token") + F.col("n_tokens")
    cut = laid.withColumn("block", F.explode(F.sequence(F.expr(f"first_token div {BLOCK}"), F.expr(f"(first_token + n_tokens - 1) div {BLOCK}"))))
    part = F.least(end, (F.col("block") + 1) * BLOCK) - F.greatest(F.col("first_token"), F.col("block") * BLOCK)
    return cut.select("source", "block", "doc_id", "n_tokens", part.alias("part"), *more)


def _slots(spark: SparkSession, targets: DataFrame, totals: dict[str | None, int]) -> DataFrame:
    """One row per slot: ``mix_name, shard, place, source, block``.

    The driver works out one number of slots per row of the fixed table of targets,
    from one total per source; shards are drawn where their groups lie.
    """
    rows = targets.select("mix_name", norm_source(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_fraction").collect()
    plans, groups = [], 0
    for mix in sorted({r.mix_name for r in rows if r.mix_name is not None}):
        own = [r for r in rows if r.mix_name == mix and r.source is not None]
        blocks = {r.source: -(-totals.get(r.source, 0) // BLOCK) for r in own}
        most = {r.source: blocks[r.source] * (r.max_repeats or 0) for r in own}
        budget = max((r.budget_fraction or 0 for r in own), default=0) * sum(totals.values()) / BLOCK
        slots = {s: n for s, n in allot(budget, {r.source: r.target_share or 0 for r in own}, most).items() if n}
        if slots:
            start, groups = groups, groups + -(-sum(slots.values()) // (SHARD * GROUP))
            plans.append((start, groups, mix, list(slots), list(slots.values()), [blocks[s] for s in slots]))
    fixed = spark.createDataFrame(plans, "start long, stop long, mix_name string, sources array<string>, slots array<long>, blocks array<long>")
    each = spark.range(groups).join(F.broadcast(fixed), (F.col("id") >= F.col("start")) & (F.col("id") < F.col("stop")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, mix, names, slots, blocks in zip(*[c.to_pylist() for c in b.columns]):
                of = dict(zip(names, blocks))
                held: list[tuple[str, np.ndarray]] = []
                at = None
                for shard, source, a, n in [*draw_shards(dict(zip(names, slots)), key_of("shards", mix), group * GROUP, (group + 1) * GROUP), (None, "", 0, 0)]:
                    if shard != at and held:
                        yield _shard(mix, at, held)
                        held = []
                    at = shard
                    if n:
                        held.append((source, _taken(mix, source, np.arange(a, a + n), of[source])))

    return each.select((F.col("id") - F.col("start")).alias("group"), "mix_name", "sources", "slots", "blocks").mapInArrow(run, "mix_name string, shard long, place int, source string, block long")


def _taken(mix: str, source: str, j: np.ndarray, blocks: int) -> np.ndarray:
    """The block that each slot of a source takes."""
    taken = np.empty_like(j)
    for p in np.unique(j // blocks):
        own = j // blocks == p
        taken[own] = permute(j[own] % blocks, blocks, key_of("pass", mix, source, int(p)))
    return taken


def _shard(mix: str, shard: int, held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """The slots of a shard, its sources shuffled."""
    n = sum(len(b) for _, b in held)
    place = permute(np.arange(n), n, key_of("places", mix, shard)).astype(np.int32)
    sources = [s for s, b in held for _ in b]
    return pa.RecordBatch.from_arrays([pa.array([mix] * n), pa.array(np.full(n, shard, np.int64)), pa.array(place), pa.array(sources), pa.array(np.concatenate([b for _, b in held]))], ["mix_name", "shard", "place", "source", "block"])


def _totals(sized: DataFrame, named: DataFrame) -> dict[str | None, int]:
    """Tokens per named source, and of all other sources as one: at most one row per row of targets and one more."""
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    known = per_source.join(F.broadcast(named.withColumn("_named", F.lit(True))), "source", "left").groupBy(F.when(F.col("_named"), F.col("source")).alias("source")).agg(F.sum("n").alias("n"))
    return {r.source: r.n for r in known.collect()}


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The chosen documents: ``mix_name, source, doc_id, uses, n_tokens, tokens_used``.

    ``uses`` is how often the most used token of the document is in the mix (at
    most ``max_repeats``), ``tokens_used`` how many of its tokens are, with
    repeats. ``docs`` has ``doc_id, source, text``; other columns are ignored.
    Only one number per source and the fixed table of targets reach the driver.
    """
    spark = docs.sparkSession
    sized = write_once(count_tokens(docs.select("doc_id", norm_source(F.col("source")).alias("source"), "text")), "sized")
    named = targets.select(norm_source(F.col("source")).alias("source")).distinct()
    times = _slots(spark, targets, _totals(sized, named)).groupBy("mix_name", "source", "block").agg(F.count(F.lit(1)).alias("times"))
    usable = sized.join(F.broadcast(named), "source", "left_semi").where("n_tokens > 0")
    used = merged(in_blocks(lay_out(usable)), times, ["source", "block"])
    return used.groupBy("mix_name", "source", "doc_id", "n_tokens").agg(F.max("times").alias("uses"), F.sum(F.col("part") * F.col("times")).alias("tokens_used")).select("mix_name", "source", "doc_id", "uses", "n_tokens", "tokens_used")


def mixed_blocks(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The tokens of every slot: ``mix_name, shard, place, source, block, ids``, as a training job reads them.

    A source's last block may be shorter than ``BLOCK``. Input as for ``mix``.
    """
    spark = docs.sparkSession
    width = id_width()
    keyed = docs.select(F.struct("doc_id", norm_source(F.col("source")).alias("source")).alias("key"), "text")
    coded = packed(encode(keyed, "key"), width).select("key.doc_id", "key.source", "ids", (F.octet_length("ids") / width).cast("long").alias("n_tokens"))
    coded = write_once(coded, "coded")
    named = targets.select(norm_source(F.col("source")).alias("source")).distinct()
    totals = _totals(coded.select("source", "n_tokens"), named)
    # More tasks for more blocks, and slowly larger ones: some 13 MB each at ten million blocks.
    tasks = max(1, math.ceil((sum(totals.values()) / BLOCK) ** 0.75 / 64))
    slots = _slots(spark, targets, totals)
    usable = coded.select("doc_id", "source", "n_tokens").join(F.broadcast(named), "source", "left_semi").where("n_tokens > 0")
    laid = in_blocks(lay_out(usable).withColumn("from_token", F.col("first_token")), "from_token").repartition(tasks, "source", "doc_id")
    parts = merged(laid, coded.select("doc_id", "source", "ids").repartition(tasks, "source", "doc_id"), ["source", "doc_id"])
    at = F.greatest(F.col("block") * BLOCK - F.col("from_token"), F.lit(0))
    cut = parts.select("source", "block", F.struct((F.col("from_token") + at).alias("at"), F.substring("ids", (at * width + 1).cast("int"), (F.col("part") * width).cast("int")).alias("ids")).alias("p"))
    joined = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b""), lambda a, p: F.concat(a, p.ids))
    whole = cut.repartition(tasks, "source", "block").groupBy("source", "block").agg(joined.alias("ids"))  # bounded by the block's size
    out = merged(slots.repartition(tasks, "source", "block"), whole, ["source", "block"]).select("mix_name", "shard", "place", "source", "block", "ids")
    return unpacked(out, width)


def id_width(path: str = VOCABULARY) -> int:
    """Bytes of an id of a vocabulary."""
    return 2 if len(read_ranks(Path(path).read_bytes())) <= 1 << 16 else 4


def _mapped_ids(df: DataFrame, kind: T.DataType, f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The table with its last column ``ids`` mapped in batches."""
    keep = df.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], f(b.column(len(keep)))], [*keep, "ids"])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], T.StructField("ids", kind)]))


def packed(df: DataFrame, width: int) -> DataFrame:
    """Lists of ids as bytes, low byte first, which halves what is shuffled."""

    def pack(ids: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))) * width
        data = ids.flatten().to_numpy(zero_copy_only=False).astype(f"<u{width}").tobytes()
        return pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    return _mapped_ids(df, T.BinaryType(), pack)


def unpacked(df: DataFrame, width: int) -> DataFrame:
    """Bytes as lists of ids again."""

    def unpack(data: pa.Array) -> pa.Array:
        parts = [x or b"" for x in data.to_pylist()]
        ends = np.append(0, np.cumsum([len(x) // width for x in parts])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), f"<u{width}").astype(np.int32)))

    return _mapped_ids(df, T.ArrayType(T.IntegerType()), unpack)


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual shares per mix and source; a source that gave nothing has 0 tokens."""
    t = targets.select("mix_name", norm_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    got = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum("tokens_used").alias("tokens"))
    whole = W.partitionBy("mix_name")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = t.join(got, ["mix_name", "source"], "left").select(*t.columns, zero("documents"), zero("most_uses"), zero("tokens"))
    return joined.withColumn("actual_share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), 6))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents of every mix with their repeats."""
    return mix(_docs(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every mix."""
    targets = table(spark, d, "mix_targets")
    return shares(mix(_docs(spark, d), targets), targets)


def p8_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The token blocks of every mix by shard and place."""
    return mixed_blocks(_docs(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_blocks": p8_blocks}
SQL: dict[str, str] = {}
