"""Best texts, blocks and tiers by words against the plain way, and what is shuffled on the way."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import query as Q
from quern.operators import evaluate, lexical, postings, retrieve

WORDS = ["pump", "Pump house", "valve", "e", "no", "台风", "杜鹃", "新闻", "报道", "1153", "zz", "never"]


def _made(spark):
    r = random.Random(5)
    texts = [(f"c{i:03}", f"p{r.randrange(60)}" if i % 11 else None, None if i % 50 == 3 else " ".join(r.choices(WORDS[:-1], k=r.randrange(9)))) for i in range(300)]
    asked = [(f"q{i}", w, r.choice("ST")) for i in range(40) for w in r.sample(WORDS, r.randrange(1, 5))] + [("q98", "新闻", "T"), ("q99", "never", "S")]
    return spark.createDataFrame(texts, "id string, block string, text string").repartition(5), spark.createDataFrame(asked, "query_id string, term string, kind string")


@pytest.mark.parametrize("pairs", [postings.PAIRS_AT_ONCE, 30])
@pytest.mark.parametrize("by", ["id", "block"])
def test_best_texts_and_blocks(spark, monkeypatch, by, pairs):
    monkeypatch.setattr(postings, "PAIRS_AT_ONCE", pairs)
    x, t = _made(spark)
    hits = lexical.counted_terms(t, x, "id", "text")
    scored = lexical.bm25(hits, x, "id", "text", t.select("query_id", "term")).join(x.select("id", "block"), "id").where(F.col(by).isNotNull())
    per = scored.groupBy("query_id", by).agg(F.min(F.round("score", 6)).alias("score"), F.max("n_terms").alias("n_terms"))
    want = {(r.query_id, r[by], r.score, r.n_terms if by == "id" else 0, r.rank) for r in lexical.top_k(per, 4, [F.col("score"), F.col(by)]).collect()}
    got = {(r.query_id, r[by], r.score, r.n_terms if by == "id" else 0, r.rank) for r in postings.best(t, x, by, "text", 4).collect()}
    assert got == want and len({q for q, *_ in got}) == 41
    assert postings.best(t.where("false"), x, by, "text", 4).count() == 0


@pytest.mark.parametrize("at_hand", [True, False])
def test_tier_counts(spark, monkeypatch, at_hand):
    if not at_hand:
        monkeypatch.setattr(lexical, "ahocorasick", None)
    x, t = _made(spark)
    plain = lexical.tiers(lexical.match_terms(t, x, "id", "text"), t, "id", Q.GENRE).groupBy("query_id", "tier").agg(F.count(F.lit(1)).alias("n"))
    got = {tuple(r) for r in postings.tier_counts(t, x, "id", "text", Q.GENRE).collect()}
    assert got == {tuple(r) for r in plain.collect()} and {k for _, k, _ in got} == {"A", "B", "C"}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """50 questions that are asked, 2,000 chunks that all hold their words."""
    d, then = str(tmp_path_factory.mktemp("library")), datetime(2024, 1, 1)
    save = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(f"{d}/{name}.parquet")
    save([(f"c{i}", f"d{i % 40}", f"p{i % 400}", f"pump valve {i}", "A") for i in range(2000)], "chunk_id string, doc_id string, parent_id string, content string, section_path string", "chunks")
    save([(f"p{i}", f"d{i % 40}", f"pump valve {i}", i, "A", 1, 2, then) for i in range(400)], "parent_id string, doc_id string, content string, ord int, section_path string, source_start_line int, source_end_line int, indexed_at timestamp", "parent_blocks")
    save([(i, f"d{i}", f"f/n{i}.md", f"N{i}") for i in range(40)], "doc_id long, doc_key string, rel_path string, title string", "documents")
    gold = "id string, query string, category string, expected struct<doc string, must_contain array<string>>"
    save([(f"q_{i * 20}", f"pump valve {i}", "k", (f"n{i % 40}.md", [f"valve {i}"])) for i in range(50)], gold, "core_gold")
    return d


def _shuffled(spark, run):
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def records():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = records()
    rows = run().collect()
    return rows, sum(n for k, n in records().items() if k not in before)


@pytest.mark.parametrize("query", [retrieve.q12_bm25, evaluate.a7_retrieval_metrics, evaluate.a13_failures, evaluate.j10_cited_lines, retrieve.q19_tiers])
def test_pairs_of_question_and_chunk_are_not_shuffled(spark, library, query):
    rows, moved = _shuffled(spark, lambda: query(spark, library))
    assert rows and moved < 50 * 2000 / 2


@pytest.mark.parametrize("runs", [None, Q.RUN])
def test_many_terms_are_sought_by_several_automata(spark, monkeypatch, runs):
    """More terms than one automaton holds are not joined on trigrams and not collected at once."""
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    monkeypatch.setattr(lexical, "SOUGHT_AT_ONCE", 3, raising=False)
    monkeypatch.setattr(lexical, "_by_grams", None)
    x = spark.createDataFrame([("台风杜鹃 Pump", 1), ("货架编号台风", 2), (None, 3), ("", 4), ("台 风向", 5)], "text string, id int")
    terms = ["台风", "台风杜", "风杜鹃", "鹃", "货架编号", "编号台风", "风向", "台 风" if runs is None else "台风向", "杜鹃货", "号号", "", None, "PUMP" if runs is None else "风"]
    t = spark.createDataFrame([(w,) for w in terms], "term string")
    args = (runs,) if runs else ()
    got = [r.term for r in lexical.present_terms(t, x, "text", *args).collect()]
    known = {"台风", "台风杜", "风杜鹃", "鹃", "货架编号", "编号台风", "风向"} | ({"台 风", "PUMP"} if runs is None else {"风"})
    assert sorted(got) == sorted(known)
    assert lexical.present_terms(t.where("false"), x, "text", *args).count() == 0 == lexical.present_terms(t, x.where("false"), "text", *args).count()


def test_terms_are_resolved_without_a_join_on_trigrams(spark, monkeypatch):
    q = spark.createDataFrame([("a", "台风杜鹃的路径图是什么？"), ("b", "根据记录，货架编号valve是多少")], "query_id string, query string")
    x = spark.createDataFrame([(1, "台风杜鹃来了"), (2, "货架上，记录 valve")], "id int, text string")
    want = {tuple(r) for r in retrieve.resolve_terms(q, x, "text").collect()}
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    monkeypatch.setattr(lexical, "SOUGHT_AT_ONCE", 3, raising=False)
    monkeypatch.setattr(lexical, "_by_grams", None)
    assert {tuple(r) for r in retrieve.resolve_terms(q, x, "text").collect()} == want
    assert {"杜鹃", "货架", "valve"} <= {t for _, _, t, *_ in want}
