"""Queries that once did less than their whole job: all questions are answered, and terms are cut to any length."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest

from quern.functions.relevance import Asked, Block
from quern.operators import evaluate, retrieve
from quern.plans import surface


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """Questions 1 to 24, of which the first twelve have a gold block, and an overview."""
    d, then = str(tmp_path_factory.mktemp("numbered")), datetime(2024, 1, 1)
    save = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(f"{d}/{name}.parquet")
    save([(f"c{i}", f"d{i % 12}", f"p{i % 24}", f"pump valve{i % 24} text {i}", "A") for i in range(48)], "chunk_id string, doc_id string, parent_id string, content string, section_path string", "chunks")
    save([(f"p{i}", f"d{i % 12}", f"pump valve{i} text", i, "A", 1, 2, then) for i in range(24)], "parent_id string, doc_id string, content string, ord int, section_path string, source_start_line int, source_end_line int, indexed_at timestamp", "parent_blocks")
    save([(i, f"d{i}", f"f/n{i}.md", f"N{i}") for i in range(12)], "doc_id long, doc_key string, rel_path string, title string", "documents")
    gold = "id string, query string, category string, expected struct<doc string, must_contain array<string>>"
    asked = [(f"q_{i:02}", f"pump valve{i - 1}", "k", (f"n{i - 1}.md", [f"valve{i - 1} "])) for i in range(1, 25)] + [("q_25", "总结 valve3 的 主要内容", "k", (None, []))]
    save([*asked, *asked[:3]], gold, "core_gold")
    return d


def test_search_metrics_count_all_gold_questions(spark, numbered):
    (got,) = evaluate.a7_search_metrics(spark, numbered).collect()
    assert (got.n, got.recall_1, got.mrr) == (12, 1.0, 1.0)


def test_relevance_in_slices_of_questions(spark, numbered, monkeypatch):
    """Blocks without pairs, pairs without blocks, and small batches give each pair its own block."""
    pairs = spark.createDataFrame([(f"q{q}", f"p{p}", q + p) for q in range(7) for p in range(0, 40, 3)], "query_id string, parent_id string, at int")
    blocks = spark.createDataFrame([(f"p{p}", "valve " * p, "S", p) for p in range(30)], "parent_id string, content string, section_path string, ord int")
    asked = spark.createDataFrame([(f"q{q}", "x", "general", [(0, "valve", float(q), True)]) for q in range(6)] + [("q6", "x", "general", None)], "query_id string, query string, qtype string, t array<struct<pos int, term string, idf double, in_target boolean>>")
    ask = [Asked("x", "general", ["valve"], [float(q)], ["valve"]) for q in range(6)] + [Asked("x", "general", [], [], [])]
    want = {(f"q{q}", f"p{p}", q + p, "general", p, ask[q].score(Block("valve " * p, "S"))) for q in range(7) for p in range(0, 30, 3)}
    monkeypatch.setattr(retrieve, "QUESTIONS_AT_ONCE", 3)
    monkeypatch.setattr(retrieve, "ASKED", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r.query_id, r.parent_id, r["at"], r.qtype, r.ord, r.relevance) for r in retrieve.relevance(pairs, blocks, asked).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_long_runs_are_cut_to_any_length(spark, tmp_path):
    """More than 23 characters are cut from a run's end, and from its beginning, like in the SQL text."""
    far = [chr(0x4E00 + 40 * i) for i in range(60)]
    begin, end = "台风杜" + "".join(far[:57]), "".join(far[:57]) + "货架号"
    save = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(begin,), (f"{end} valve",), ("".join(far[30:]),), ("台风",), ("台",), ("风台",), (None,)], "query string", "core_gold")
    save([("台风杜鹃",), ("旧货架号",), ("pump",), (None,)], "content string", "chunks")
    got = {tuple(r) for r in surface.q15_trimmed_terms(spark, str(tmp_path)).collect()}
    assert got == {(begin, "台风杜"), (end, "货架号"), ("台风", "台风")}
    con = duckdb.connect()
    for name in ("core_gold", "chunks"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(con.sql(surface.SQL["q15_trimmed_terms"]).fetchall()) == got
    x = spark.read.parquet(f"{tmp_path}/chunks.parquet")
    terms = retrieve.resolve_terms(spark.createDataFrame([("a", begin), ("b", end)], "query_id string, query string"), x, "content").collect()
    assert {t.query_id for t in terms} == {"a", "b"}


def test_all_questions_are_explained(spark, numbered):
    assert {r.query_id for r in retrieve.q23_explained(spark, numbered).select("query_id").distinct().collect()} == {f"q_{i:02}" for i in range(1, 26)}


def test_all_questions_are_summed_up(spark, numbered):
    """Answers are counted without ranking those that are no overviews, and are as many as the search gives."""
    got = {tuple(r) for r in retrieve.v14_summary(spark, numbered).collect()}
    q, (chunks, blocks, notes) = retrieve._questions(spark, numbered), retrieve._kept(spark, numbered)
    assert got == {tuple(r) for r in retrieve.search(q, chunks, blocks, notes, retrieve._vectors(spark, chunks)).summary.collect()}
    assert len(got) == 25 and {n for *_, n, _ in got} > {5}
