"""Nearest neighbours and the search that reads them: ties, slices of queries, and what is shuffled on the way."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import relevance
from quern.operators import evaluate, lexical, retrieve, vector
from test_postings import _shuffled, library  # noqa: F401


def test_many_equal_vectors_are_taken_by_id(spark):
    """More equally near rows than any margin around ``k``."""
    e = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(999, -1, -1)], "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, embedding array<float>")
    got = {(r.query_id, r.id, r.rank) for r in vector.nearest(e, q, 3).collect()}
    assert got == {(7, 1, 1), (7, 3, 2), (7, 5, 3), (8, 0, 1), (8, 2, 2), (8, 4, 3)}


@pytest.mark.parametrize("at_once", [16_384, 9])
def test_nearest_by_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", at_once, raising=False)
    r = random.Random(3)
    rows = [(f"v{i:03}", [float(r.randrange(4)) for _ in range(r.choice([3, 5]))]) for i in range(400)] + [("none", None), ("gap", [1.0, None, 2.0])]
    asked = [(f"q{i}", [r.random() * 4 for _ in range(r.choice([3, 5]))]) for i in range(30)]
    e, q = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3), spark.createDataFrame(asked, "query_id string, embedding array<double>")
    far = lambda a, b: round(float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), 9)
    want = {(i, v, k) for i, a in asked for k, (_, v) in enumerate(sorted((far(a, x), v) for v, x in rows[:400] if len(x) == len(a))[:4], 1)}
    assert {(x.query_id, x.id, x.rank) for x in vector.nearest(e, q, 4).collect()} == want


def test_pairs_of_query_and_block_are_not_joined(spark):
    """A task gives ``k`` rows per query, whatever its number of blocks."""
    e = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding")).coalesce(1)
    q = e.where("vec_id < 50").withColumnRenamed("vec_id", "query_id")
    rows, moved = _shuffled(spark, lambda: vector.nearest(e, q, 5))
    assert len(rows) == 250 and moved <= 250


@pytest.mark.parametrize("query", [evaluate.a7_search_metrics, retrieve.v15_hybrid_search])
def test_search_reads_blocks_once(spark, library, monkeypatch, query):  # noqa: F811
    """Duplicates of blocks are looked for by one shuffle of their contents, not by every stage."""
    written = []
    kept = retrieve.write_once
    monkeypatch.setattr(retrieve, "write_once", lambda df, name: written.append(name) or kept(df, name))
    assert query(spark, library).count()
    assert {"chunks", "blocks"} <= set(written) and "vectors" not in written


def test_patterns_are_made_for_the_kinds_that_need_them():
    """A task meets thousands of questions; only those for a quantity need a pattern of their own."""
    block = relevance.Block("# Pump\nvalve 12 | 负责人", "Valves")
    for kind in ("general", "person", "model", "quantity"):
        asked = relevance.Asked("valve", kind, ["valve", "pump"], [2.0, 1.0], ["valve"])
        assert asked.score(block) == asked.relevance(block.content, block.section) + asked.bonus(block.content, block.section)
        assert ("digit" in vars(asked)) == (kind == "quantity")


def test_both_strict_tiers_take_one_look_at_the_texts(spark, monkeypatch):
    looks = []
    plain = lexical.with_all_terms
    monkeypatch.setattr(lexical, "with_all_terms", lambda w, t: looks.append(t) or plain(w, t))
    x = spark.createDataFrame([("c1", "pump valve"), ("c2", "valve"), ("c3", "pump")], "id string, text string")
    t = spark.createDataFrame([("a", 0, "pump", False), ("a", 1, "valve", True), ("b", 0, "pump", True)], "query_id string, pos int, term string, in_target boolean")
    got = lexical.candidates(lexical.counted_terms(t, x, "id", "text"), x, t, 5, "id", "text")
    assert sorted((r.query_id, r.id, r.tier) for r in got.collect()) == [("a", "c1", "A"), ("a", "c2", "B"), ("b", "c1", "A"), ("b", "c3", "A")]
    assert len(looks) == 1
