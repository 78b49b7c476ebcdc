"""Near-duplicate records with small edits, by a grouped prefix join.

Similarity is the Jaccard coefficient of the sets of ``GRAM``-character strings
of two texts, lower-cased and with runs of white space as one space.

1. Each text gets a signature: two one-permutation hashings of its gram set into
   ``BINS`` bins each. ``ROWS`` neighbouring bins make one element, and the
   ``2 * BINS / ROWS`` elements are the text's prefix: two texts at the threshold
   have none in common with a probability of about 0.3 %, at 0.8 of 0.01 %.
2. Records with an identical prefix and the same number of grams are one group,
   combined on the map side; copies thus cost one group however many there are. A
   group of more than ``TEXTS`` different texts is parted into groups of that size.
3. Groups that share an element of their prefix are paired. A pair is filtered by
   size and by 64 bits of the signature. The groups of an element that more than
   ``CROWD`` share are dealt into blocks of about ``BLOCK``, and each block meets
   each other one in a task of its own, so none of their pairs is left out.
4. Pairs are expanded to classes of equal texts, and each pair of classes is
   verified by the exact coefficient.

Defined results: texts shorter than ``MIN_CHARS`` (as compared) and null ones are
in no pair, nor is a record with itself; null ids are dropped and repeated rows
count once. All pairs of members are returned unless two classes have more than
``EXPAND`` of them: then each member is paired with its class's first id and the
two first ids with each other, from which the rest follows. Columns besides id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.textarrays import gram_hashes, mix, points_of
from quern.operators.skew import lookup, merged
from quern.session import table, write_once

GRAM = 5
THRESHOLD = 0.75
MIN_CHARS = 200
#: Bins of each of the two hashings, and bins joined to one element.
BINS, ROWS = 140, 7
#: Bits of 64 that the small signatures of a pair must share; at the threshold 56 are expected, with a deviation of 2.6.
BITS = 45
#: Groups that may share an element before they are dealt into blocks, and groups of a block.
CROWD, BLOCK = 300, 2000
#: Different texts in a group.
TEXTS = 1000
#: Bits of a gram's hash that are sorted beside its text's number.
HASH_BITS = 44
#: Pairs of members written out for a pair of classes.
EXPAND = 10_000

_SALTS = [np.uint64(0x51ED270B7A64D1F3), np.uint64(0xA3B195354A39B70D)]


def normal(text: str) -> str:
    """Lower-cased, runs of white space as one space, none outside."""
    return " ".join(text.lower().split())


def grams(text: str) -> np.ndarray:
    """Distinct gram hashes of a normalised text, sorted."""
    return np.unique(gram_hashes(points_of(text), GRAM))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of grams, prefix elements and 64 bits of each normalised text, all at once.

    The grams of all texts are hashed in one array and sorted by text and hash, so
    the first of each bin is its least hash. An empty bin borrows from the next
    full one, marked by the distance.
    """
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    points = points_of("".join(texts))
    h = gram_hashes(points, GRAM)
    owner = np.repeat(np.arange(n, dtype=np.uint64), lengths)[: len(h)]
    ends = np.cumsum(lengths)
    inside = np.arange(len(h)) + GRAM <= np.repeat(ends, lengths)[: len(h)]
    h, owner = h[inside], owner[inside]
    sizes = np.zeros(n, np.int64)
    elements = np.zeros((n, 2 * BINS // ROWS), np.uint64)
    bits = np.zeros(n, np.uint64)
    low = np.uint64((1 << HASH_BITS) - 1)
    for k, salt in enumerate(_SALTS):
        key = np.sort(owner << np.uint64(HASH_BITS) | mix(h ^ salt) >> np.uint64(64 - HASH_BITS))
        if not k:
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            sizes = np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)
        value = key & low
        cell = (key >> np.uint64(HASH_BITS)).astype(np.int64) * BINS + (value * np.uint64(BINS) >> np.uint64(HASH_BITS)).astype(np.int64)
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        least = np.zeros(n * BINS, np.uint64)
        full = np.zeros(n * BINS, bool)
        least[cell[first]], full[cell[first]] = value[first], True
        full = full.reshape(n, BINS)
        here = np.arange(BINS)
        twice = np.concatenate([np.where(full, here, 2 * BINS), np.where(full, here + BINS, 2 * BINS)], axis=1)
        nxt = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        values = mix(np.take_along_axis(least.reshape(n, BINS), nxt % BINS, axis=1) + (nxt - here).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        joined = np.zeros((n, BINS // ROWS), np.uint64)
        for r in range(ROWS):
            joined = mix(joined ^ values[:, r::ROWS]) + np.uint64(r)
        width = BINS // ROWS
        elements[:, k * width : (k + 1) * width] = mix(joined + (np.arange(width) + k * width).astype(np.uint64))
        bits |= ((values[:, :32] & np.uint64(1)) << np.arange(32, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(32 * k)
    return sizes, elements.view(np.int64), bits.view(np.int64)


#: Characters of text whose signatures are made at once.
SLICE_CHARS = 300_000


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``src, id, text`` to ``src, id, text_key, size, elements, bits``."""
    width = 2 * BINS // ROWS
    names = ["src_table", "id", "text_key", "size", "elements", "bits"]

    def flush(held: list[tuple[str, str, str]]) -> pa.RecordBatch:
        texts = [t for _, _, t in held]
        sizes, elements, bits = signatures(texts)
        keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(held) * width + 1, width, dtype=np.int32)), pa.array(elements.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in held]), pa.array([i for _, i, _ in held]), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int32)), lists, pa.array(bits)], names)

    held: list[tuple[str, str, str]] = []
    chars = 0
    for b in batches:
        for s, i, t in zip(*[c.to_pylist() for c in b.columns]):
            if i is None or t is None or len(t) < MIN_CHARS // 2 or len(n := normal(t)) < MIN_CHARS:
                continue
            held.append((s, i, n))
            chars += len(n)
            if chars >= SLICE_CHARS:
                yield flush(held)
                held, chars = [], 0
    if held:
        yield flush(held)


def _meet(key: np.ndarray, group: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups with equal keys that pass the filters; rows are sorted by key."""
    out_a, out_b = [], []
    at, k = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + k < len(key)]
        at = at[key[at + k] == key[at]]
        a, b = at, at + k
        like = np.bitwise_count(~(bits[a] ^ bits[b]).view(np.uint64)) >= BITS
        near = np.minimum(size[a], size[b]) >= THRESHOLD * np.maximum(size[a], size[b])
        ok = like & near & (group[a] != group[b])
        out_a.append(np.minimum(group[a[ok]], group[b[ok]]))
        out_b.append(np.maximum(group[a[ok]], group[b[ok]]))
        k += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _pairs(most: int):  # noqa: ANN202
    """Rows ``key, grp, size, bits`` sorted by key to pairs ``a, b``; crowds of over ``most`` come back as ``a`` = key, ``b`` = group with ``size, bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(rows[3]), pa.array(np.full(len(rows[0]), True))], ["a", "b", "size", "bits", "crowd"])

        held = [np.zeros(0, np.int64) for _ in range(4)]
        crowded = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if crowded is not None:  # a crowd goes on: pass its rows through
                same = int(np.searchsorted(cols[0], crowded, side="right"))
                if same:
                    yield emit([c[:same] for c in cols])
                    cols = [c[same:] for c in cols]
                if len(cols[0]):
                    crowded = None
            held = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            key = held[0]
            if not len(key):
                continue
            tail = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if len(key) - tail > most:
                yield emit([h[tail:] for h in held])
                crowded, cut = key[-1], tail
                rest = [h[:0] for h in held]
            else:
                cut, rest = tail, [h[tail:] for h in held]
            yield from _runs([h[:cut] for h in held], most, emit)
            held = rest
        yield from _runs(held, most, emit)

    return run


def _runs(rows: list[np.ndarray], most: int, emit) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    key = rows[0]
    if not len(key):
        return
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(start, len(key)))
    big = np.repeat(n > most, n)
    if big.any():
        yield emit([r[big] for r in rows])
        rows = [r[~big] for r in rows]
    a, b = _meet(*rows)
    for i in range(0, len(a), 100_000):
        x, y = a[i : i + 100_000], b[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64()), pa.array(np.full(len(x), False))], ["a", "b", "size", "bits", "crowd"])


def _across(group: np.ndarray, size: np.ndarray, bits: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of groups of side 0 with those of side 1 that pass the filters."""
    other = np.flatnonzero(side == 1)
    other = other[np.argsort(size[other], kind="stable")]
    g, s, b = group[other], size[other], bits[other]
    for i in np.flatnonzero(side == 0):
        lo, hi = np.searchsorted(s, np.ceil(THRESHOLD * size[i])), np.searchsorted(s, size[i] / THRESHOLD, side="right")
        ok = np.bitwise_count(~(b[lo:hi] ^ bits[i]).view(np.uint64)) >= BITS
        near = g[lo:hi][ok]
        yield np.minimum(near, group[i]), np.maximum(near, group[i])


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, grp, size, bits, side`` sorted by part to pairs ``a, b``: of its two sides, or of all its rows if it has one."""

    def flush(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in np.split(np.arange(len(rows[0])), np.flatnonzero(np.diff(rows[0])) + 1) if len(rows[0]) else []:
            part, group, size, bits, side = [r[at] for r in rows]
            met, n = [], 0
            for a, b in _across(group, size, bits, side) if side.any() else [_meet(part, group, size, bits)]:
                met.append((a, b))
                n += len(a)
                if n >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*met)], ["a", "b"])
                    met, n = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*met)], ["a", "b"])

    held = [np.zeros(0, np.int64) for _ in range(5)]
    for batch in batches:
        held = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last part may go on
        yield from flush([h[:cut] for h in held])
        held = [h[cut:] for h in held]
    yield from flush(held)


def crowd_pairs(crowd: DataFrame) -> DataFrame:
    """All pairs ``a, b`` of groups with equal keys that pass the filters (rows ``key, grp, size, bits``), block by block."""
    n = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("_refs"))
    sized = lookup(crowd, n.withColumn("blocks", F.ceil(F.col("_refs") / F.lit(BLOCK)).cast("int")), "key")
    own = sized.withColumn("own", F.pmod(F.xxhash64("grp"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    part = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("part")
    rows = each.select(part, "grp", "size", "bits", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_squares, "a long, b long")


def sketches(records: DataFrame) -> DataFrame:
    """Signatures of all records (``src_table, id, text``), written once; ``grp`` names prefix and size."""
    s = records.mapInArrow(_sketch, "src_table string, id string, text_key binary, size int, elements array<long>, bits long")
    return parted(write_once(s.withColumn("grp", F.xxhash64("src_table", "size", "elements")), "sketches"))


def parted(sk: DataFrame) -> DataFrame:
    """Groups of more than ``TEXTS`` different texts in parts; the parts share all elements, so they are paired like other groups."""
    texts = sk.groupBy("grp", "text_key").agg(F.count(F.lit(1)).alias("n"))
    many = texts.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("_refs")).where(F.col("n") > TEXTS).withColumn("parts", F.ceil(F.col("n") / F.lit(TEXTS)).cast("int")).select("grp", "parts", "_refs")
    many = write_once(many, "many")
    if many.isEmpty():
        return sk
    part = F.xxhash64("grp", F.pmod(F.xxhash64("text_key"), F.col("parts")))
    return write_once(lookup(sk, many, "grp").withColumn("grp", F.coalesce(part, F.col("grp"))).drop("parts"), "parted")


def group_pairs(sk: DataFrame) -> DataFrame:
    """Pairs of groups that share an element and pass the filters: ``a, b``."""
    groups = sk.groupBy("grp").agg(F.first("src_table").alias("src_table"), F.first("size").alias("size"), F.first("elements").alias("elements"), F.first("bits").alias("bits"))
    rows = groups.select(F.explode("elements").alias("e"), "src_table", "grp", "size", "bits").select(F.xxhash64("src_table", "e").alias("key"), "grp", "size", "bits")
    met = write_once(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(CROWD), "a long, b long, size int, bits long, crowd boolean"), "met")
    more = crowd_pairs(met.where("crowd").select(F.col("a").alias("key"), F.col("b").alias("grp"), "size", "bits"))
    return met.where("not crowd").select("a", "b").unionByName(more).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, np.ndarray] = {}

    def of(key: bytes, text: str) -> np.ndarray:
        if key not in memo:
            if len(memo) > 256:
                memo.clear()
            memo[key] = grams(normal(text))
        return memo[key]

    for b in batches:
        a, c, ta, tc = [col.to_pylist() for col in b.columns]
        j = [jaccard(of(x, p), of(y, q)) for x, y, p, q in zip(a, c, ta, tc)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j, pa.float64())], ["key_a", "key_b", "similarity"])


def class_pairs(records: DataFrame, sk: DataFrame) -> DataFrame:
    """Verified pairs of different texts: ``key_a, key_b, similarity``. The keys are those of the texts, whatever their table."""
    classes = sk.groupBy("grp", "text_key", "src_table").agg(F.min("id").alias("id"))
    side = lambda n: classes.select(F.col("grp").alias(f"g{n}"), F.col("text_key").alias(f"key_{n}"))
    across = merged(group_pairs(sk), side("a"), F.col("a") == F.col("ga"))
    across = merged(across, side("b"), F.col("b") == F.col("gb")).select(F.col("ga").alias("g1"), "key_a", F.col("gb").alias("g2"), "key_b")
    # A group has a bounded number of texts, so these pairs are few per group.
    several = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    multi = merged(classes, several, "grp").select("grp", "text_key")
    one, two = multi.select(F.col("grp").alias("g1"), F.col("text_key").alias("key_a")), multi.select(F.col("grp").alias("g2"), F.col("text_key").alias("key_b"))
    inside = merged(one, two, (F.col("g1") == F.col("g2")) & (F.col("key_a") < F.col("key_b")))
    pairs = write_once(across.unionByName(inside), "pairs")
    ends = pairs.select(F.col("g1").alias("grp"), F.col("key_a").alias("text_key")).unionByName(pairs.select(F.col("g2").alias("grp"), F.col("key_b").alias("text_key"))).distinct()
    wanted = merged(classes, ends, ["grp", "text_key"]).select("src_table", "id", "grp", "text_key")
    texts = write_once(merged(records.where("id is not null"), wanted, ["src_table", "id"]).select("grp", "text_key", "text").dropDuplicates(["grp", "text_key"]), "texts")
    left = texts.select(F.col("grp").alias("g1"), F.col("text_key").alias("key_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("grp").alias("g2"), F.col("text_key").alias("key_b"), F.col("text").alias("text_b"))
    full = merged(merged(pairs, left, ["g1", "key_a"]), right, ["g2", "key_b"])
    checked = full.select("key_a", "key_b", "text_a", "text_b").mapInArrow(_verify, "key_a binary, key_b binary, similarity double")
    return checked.where(F.col("similarity") >= THRESHOLD)


def near_duplicates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``src_table, text_key, id``, one row per record) and verified pairs of their classes."""
    sk = sketches(records)
    return sk.select("src_table", "text_key", "id").distinct(), class_pairs(records, sk)


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of ids of each table: ``src_table, id_a, id_b`` with the smaller id first."""
    keyed = members.withColumn("k", _key(F.col("text_key")))
    sizes = keyed.groupBy("k", "src_table").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    side = lambda s: sizes.select(F.col("k").alias(f"k_{s}"), "src_table", F.col("n").alias(f"n_{s}"), F.col("first").alias(f"first_{s}"))
    ends = pairs.select(_key(F.col("key_a")).alias("k_a"), _key(F.col("key_b")).alias("k_b")).distinct()
    sized = merged(merged(ends, side("a"), "k_a"), side("b"), ["k_b", "src_table"])
    many = F.col("n_a") * F.col("n_b") > EXPAND
    # Only members of small classes are made pairs, so no key has more rows than that.
    own = lambda s: keyed.select(F.col("k").alias(f"k_{s}"), "src_table", F.col("id").alias(f"id_{s}"))
    small = merged(merged(sized.where(~many), own("a"), ["k_a", "src_table"]), own("b"), ["k_b", "src_table"]).select("src_table", "id_a", "id_b")
    firsts = sized.where(many).select("src_table", F.col("first_a").alias("id_a"), F.col("first_b").alias("id_b"))
    both = small.unionByName(firsts).select("src_table", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    facts = sizes.where("n > 1").select(F.concat_ws("/", "src_table", "k").alias("c"), "n", "first", F.col("n").alias("_refs"))
    copies = lookup(keyed.select("src_table", "id", F.concat_ws("/", "src_table", "k").alias("c")), facts, "c").where("n > 1")
    few = copies.where(F.col("n") * F.col("n") <= EXPAND)
    inside = merged(few.select("src_table", "c", F.col("id").alias("id_a")), few.select("c", F.col("id").alias("id_b")), "c").where("id_a < id_b").select("src_table", "id_a", "id_b")
    star = copies.where((F.col("n") * F.col("n") > EXPAND) & (F.col("id") != F.col("first"))).select("src_table", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    return both.unionByName(inside).unionByName(star).where("id_a < id_b").distinct()


def _key(c: Column) -> Column:
    return F.hex(c)


def _records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_key").alias("id"), "text")
    blocks = table(spark, d, "parent_blocks").select(F.lit("parent_blocks").alias("src_table"), F.col("parent_id").alias("id"), F.col("content").alias("text"))
    return docs.unionByName(blocks)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of notes and pairs of blocks that are versions of each other."""
    members, pairs = near_duplicates(_records(spark, d))
    return expand(members, pairs)


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class of equal texts (named by its first id), the class's size and its links to other texts."""
    members, pairs = near_duplicates(_records(spark, d))
    named = F.concat_ws("/", "src_table", _key(F.col("text_key"))).alias("c")
    keyed = members.select("src_table", "id", "text_key", named)
    sizes = keyed.groupBy("c", "text_key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("class_id"), F.first("src_table").alias("src_table"))
    ends = pairs.select("key_a", "key_b").unionByName(pairs.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"))).distinct()
    held = sizes.select("src_table", F.col("text_key").alias("key_b"))
    links = merged(ends, held, "key_b").groupBy("src_table", F.col("key_a").alias("text_key")).agg(F.count(F.lit(1)).alias("n_links"))
    facts = merged(sizes, links, ["src_table", "text_key"], "left").select("c", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_copies").alias("_refs"))
    return lookup(keyed.select("src_table", "id", "c"), facts, "c").select("src_table", "id", "class_id", "n_copies", "n_links")


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
# Texts as compared, their distinct strings, and how many of them two texts have in common, by a plain join.
_PAIRS = f"""with r as (select 'documents' src_table, doc_key id, text t from documents union all select 'parent_blocks', parent_id, content from parent_blocks),
 n as (select distinct src_table, id, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) t from r where id is not null and t is not null), c as (select src_table, t, count(distinct id) n_copies, min(id) class_id, row_number() over () k from n where length(t) >= {MIN_CHARS} group by 1, 2),
 g as (select distinct src_table, k, hash(substring(t, i, {GRAM})) g from c, unnest(range(1, length(t) - {GRAM} + 2)) x(i)), z as (select k, count(*) z from g group by 1),
 w as (select g.*, z from g join z using (k)), d as (select src_table, a.k ka, b.k kb, count(*) both_, any_value(a.z) za, any_value(b.z) zb from w a join w b using (src_table, g) where a.k < b.k and least(a.z, b.z) >= {THRESHOLD} * greatest(a.z, b.z) group by 1, 2, 3),
 p as (select * from d where both_ >= {THRESHOLD} * (za + zb - both_)), m as (select n.src_table, n.id, c.k, n_copies, class_id from n join c using (src_table, t))"""
SQL = {
    "p6_found": _PAIRS + """ select distinct src_table, least(x, y) as id_a, greatest(x, y) as id_b from (
 select a.src_table, a.id x, b.id y from p join m a on a.k = ka join m b on b.k = kb union all select a.src_table, a.id, b.id from m a join m b on a.k = b.k and a.id < b.id) where x <> y""",
    "p6_classes": _PAIRS + """, l as (select k, count(*) n from (select ka k from p union all select kb from p) group by 1)
 select distinct src_table, id, class_id, n_copies, coalesce(n, 0) as n_links from m left join l using (k)""",
}
