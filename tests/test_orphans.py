"""References to records that do not exist."""

from __future__ import annotations

from datetime import datetime as T

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import orphans as O
from quern.operators import skew

REFS = "id string, ref string, at timestamp, key string, end string"
PARENTS = "key string, at timestamp"


def judged(spark, refs, parents, deleted=None):
    r = spark.createDataFrame([(i, k, t, "clash", "clash") for i, k, t in refs], REFS)
    p = spark.createDataFrame(parents, PARENTS)
    d = None if deleted is None else spark.createDataFrame([(x,) for x in deleted], "key string")
    return {x.id: x.orphan for x in O.find_orphans(r, p, d).collect()}


def test_kinds_and_ways_of_writing(spark):
    parents = [("a:p0", T(2023, 1, 5)), ("a:p1", T(2023, 1, 5)), ("a:p1", T(2023, 3, 1)), ("b7", None), (None, T(2023, 1, 1))]
    refs = [("same", " A:P1 ", T(2023, 2, 1)), ("gone", "a:p2", T(2023, 2, 1)), ("before", "a:p0", T(2023, 1, 1)), ("blank", "  ", None), ("null", None, T(2023, 1, 1)), ("untimed", "b7", T(2000, 1, 1)), ("padded", "a:p01", None)]
    got = judged(spark, refs, parents)
    assert got == {"same": None, "gone": "missing", "before": "later", "blank": None, "null": None, "untimed": None, "padded": "missing"}


def test_deleted_and_repeated_rows(spark):
    t = T(2023, 5, 1)
    refs = [("x", "a1", t), ("x", "a1", t), ("y", "a2", t)]
    r = O.find_orphans(spark.createDataFrame([(i, k, a, "", "") for i, k, a in refs], REFS), spark.createDataFrame([("a1", t), ("a2", t)], PARENTS), spark.createDataFrame([("A1",), ("A1",), (None,)], "key string"))
    assert sorted((x.id, x.orphan) for x in r.collect()) == [("x", "deleted"), ("x", "deleted"), ("y", None)]


def test_empty_tables(spark):
    assert judged(spark, [], [("a", None)]) == {}
    assert judged(spark, [("x", "a", None)], []) == {"x": "missing"}


def test_runs_cross_no_block(spark):
    keys = [(f"k{n}",) for n in [*range(65530, 65545), 7, 9, 10]]
    runs = sorted((r.run_start, r.run_end) for r in O.runs_of(spark.createDataFrame(keys, "key string")).collect())
    assert runs == [(7, 7), (9, 10), (65530, 65535), (65536, 65544)]


def test_hot_key_keeps_all_rows(spark):
    refs = [(str(i), "hot" if i % 3 == 0 else f"c{i}", None) for i in range(3000)]
    parents = [("hot", None)] + [(f"c{i}", None) for i in range(0, 3000, 2)]
    got = judged(spark, refs, parents)
    want = {str(i): None if i % 3 == 0 or i % 2 == 0 else "missing" for i in range(3000)}
    assert got == want
    rows = spark.createDataFrame(refs, "id string, ref string, x string")
    assert [r.ref for r in skew.hot_keys(rows, "ref").collect()] == ["hot"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["a1", "a2", "a02", "a9", "b", "b10", "", "7", "a18446744073709551616"]), max_size=12), st.lists(st.sampled_from(["a1", "a2", "a02", "a3", "b", "b1", "7", "07", "a18446744073709551616"]), max_size=12))
def test_equals_plain_lookup(spark, parents, refs):
    got = judged(spark, [(str(i), r, None) for i, r in enumerate(refs)], [(p, None) for p in parents])
    assert got == {str(i): None if r in parents else "missing" for i, r in enumerate(refs)}


def test_split_key_is_reversible(spark):
    keys = ["6dc8:p12", "a007", "0", "x", "12345678901234567890", "é9"]
    rows = O.split_key(spark.createDataFrame([(k,) for k in keys], "key string"), "key").withColumn("again", F.when(F.col("num") < 0, F.col("stem")).otherwise(F.concat("stem", F.col("num").cast("string")))).collect()
    assert all(r.again == r.key for r in rows)
