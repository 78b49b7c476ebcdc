"""Quality of retrieval as aggregates over rankings and gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import query as Q
from quern.operators import postings, retrieve
from quern.operators.skew import merged
from quern.session import table, write_once


def first_gold_rank(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question the rank of its first gold answer, or null: ``query_id, first``. Questions come from ``gold``."""
    hit = ranking.join(gold.select("query_id", "answer").distinct(), ["query_id", "answer"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left")


def retrieval_metrics(first: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall at 1, 3 and 5 and mean reciprocal rank, rounded to 6."""
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return first.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


#: Ranks of the second ranking that one task counts at once.
RANK_BLOCK = 4096


def concordant_pairs(ranks: DataFrame) -> DataFrame:
    """Per query (``query_id, ra, rb``, ranks from 1 in two rankings) its answers' pairs and those in the same order: ``query_id, pairs, same``.

    No pair is listed. The highest bit in which two ``ra`` differ tells which comes
    first; for each bit, the answers with equal bits above are counted along ``rb``:
    one with the bit set follows all those without it that came before. Counts are
    taken in blocks of ``rb`` first, so no task takes all of a long ranking.
    """
    n = ranks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("ra").alias("top"))
    bits = F.ceil(F.log2(F.col("top") + 1.0)).cast("int")
    sized = merged(ranks, n.select("query_id", bits.alias("bits")), "query_id")
    each = sized.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("bits")))).withColumn("above", F.expr("shiftright(ra, bit + 1)")).withColumn("set", F.expr("shiftright(ra, bit) & 1")).withColumn("block", F.expr(f"rb div {RANK_BLOCK}"))
    key = ["query_id", "bit", "above"]
    per_block = each.groupBy(*key, "block").agg(F.count_if(F.col("set") == 0).alias("zeros"))
    before = F.coalesce(F.sum("zeros").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per_block.select(*key, "block", before.alias("start"))
    within = F.sum(1 - F.col("set")).over(W.partitionBy(*key, "block").orderBy("rb").rowsBetween(W.unboundedPreceding, -1))
    counted = merged(each, starts, [*key, "block"]).withColumn("zeros", F.coalesce(within, F.lit(0)) + F.col("start"))
    same = counted.where("set = 1").groupBy("query_id").agg(F.sum("zeros").alias("same"))
    return n.join(same, "query_id", "left").select("query_id", F.expr("n * (n - 1) div 2").alias("pairs"), F.coalesce("same", F.lit(0)).cast("long").alias("same"))


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How far two rankings (``query_id, answer, rank``) agree: same first, same first three, order of all pairs."""
    top = lambda x, k, n: x.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list("answer")).alias(n))
    heads = top(a, 1, "a1").join(top(b, 1, "b1"), "query_id").join(top(a, 3, "a3"), "query_id").join(top(b, 3, "b3"), "query_id")
    both = merged(a.select("query_id", "answer", F.col("rank").cast("long").alias("ra")), b.select("query_id", "answer", F.col("rank").cast("long").alias("rb")), ["query_id", "answer"])
    pairs = concordant_pairs(both.select("query_id", "ra", "rb")).agg(F.round(F.sum("same") / F.sum("pairs"), 6).alias("pair_order"))
    return heads.agg(F.round(F.avg((F.col("a1") == F.col("b1")).cast("double")), 6).alias("top_1"), F.round(F.avg((F.col("a3") == F.col("b3")).cast("double")), 6).alias("top_3")).join(F.broadcast(pairs))


def gold_blocks(gold: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """``query_id, answer`` of gold questions (``query_id, doc, must_contain``): blocks of the named note with all the words, else those with any.

    ``blocks``: ``parent_id, doc_id, content``; ``notes``: ``doc_id, name``.
    """
    named = merged(gold.join(notes.select("doc_id", F.col("name").alias("doc")), "doc"), blocks.select("parent_id", "doc_id", "content"), "doc_id")
    low = F.lower("content")
    held = F.size(F.filter("must_contain", lambda w: low.contains(F.lower(w))))
    hit = named.withColumn("held", held).where("held > 0").withColumn("whole", F.col("held") == F.size("must_contain"))
    best = hit.withColumn("any", F.max("whole").over(W.partitionBy("query_id"))).where(F.col("whole") | ~F.col("any"))
    return best.select("query_id", F.col("parent_id").alias("answer")).distinct()


def failure_classes(first: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Why a question failed: ``recall`` (no gold block among the candidates), ``rerank`` (one, but not among the first ``k``), else ``ok``; without gold ``none``."""
    kind = F.when(F.col("first").isNull(), "recall").when(F.col("first") > k, "rerank").otherwise("ok")
    has = gold.select("query_id").distinct().withColumn("has", F.lit(True))
    return first.join(has, "query_id", "left").select("query_id", F.when(F.col("has"), kind).otherwise("none").alias("class"))


def overlapping_lines(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """Citations (``query_id, doc_id, parent_id, a, z``) whose lines overlap those of a gold block (``query_id, doc_id, ga, gz``)."""
    met = cited.join(gold.select("query_id", "doc_id", "ga", "gz"), ["query_id", "doc_id"])
    return met.where("a <= gz and z >= ga").select("query_id", "parent_id").distinct()


def _gold(s: SparkSession, d: str, questions: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """The gold blocks of the questions: ``query_id, answer``."""
    g = table(s, d, "core_gold").where("expected.doc is not null and size(expected.must_contain) > 0").groupBy(F.col("id").alias("query_id")).agg(F.min("expected.doc").alias("doc"), F.min("expected.must_contain").alias("must_contain"), F.min("category").alias("category"))
    gold = gold_blocks(g.join(questions.select("query_id"), "query_id"), blocks, notes.select("doc_id", F.substring_index("rel_path", "/", -1).alias("name")))
    return write_once(gold, "gold")


def _answered(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranking of blocks for the stated questions by their best chunk's score, the gold blocks, and the questions."""
    q, (chunks, blocks, notes) = retrieve._asked(s, d), retrieve._library(s, d)
    t = q.select("query_id", F.explode(F.array_distinct(F.transform(Q.content_terms(F.col("query")), F.lower))).alias("term"))
    ranking = postings.best(t, chunks, "parent_id", "content", 30).select("query_id", F.col("parent_id").alias("answer"), "rank")
    return write_once(ranking, "ranking"), _gold(s, d, q, blocks, notes), q


def _ranking(s: SparkSession, d: str) -> DataFrame:
    """Notes of each host by size and by time, which stand for two rankings of one query."""
    return table(s, d, "documents").where("host is not null").select(F.col("host").alias("query_id"), F.col("doc_id").alias("answer"), "file_size", "mtime", F.col("status"))


def a7_retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    """Quality of the ranking by words for the questions whose number is divisible by 20 and that have a gold block."""
    ranking, gold, _ = _answered(s, d)
    return retrieval_metrics(first_gold_rank(ranking, gold))


def a7_search_metrics(s: SparkSession, d: str) -> DataFrame:
    """The same of the hybrid search's own ranking, for all gold questions.

    Only those with a gold block count, so only these are searched for.
    """
    chunks, blocks, notes = retrieve._kept(s, d)
    q = retrieve._questions(s, d)
    gold = _gold(s, d, q, blocks, notes)
    q = write_once(q.join(gold.select("query_id").distinct(), "query_id", "left_semi"), "counted")
    found = retrieve.search(q, chunks, blocks, notes, retrieve._vectors(s, chunks, 2)).ranked
    return retrieval_metrics(first_gold_rank(found.select("query_id", F.col("parent_id").alias("answer"), F.col("ref").alias("rank")), gold))


def a13_failures(s: SparkSession, d: str) -> DataFrame:
    """Questions by the stage in which their gold block was lost."""
    ranking, gold, q = _answered(s, d)
    first = q.select("query_id").join(first_gold_rank(ranking, gold), "query_id", "left")
    return failure_classes(first, gold).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def j10_cited_lines(s: SparkSession, d: str) -> DataFrame:
    """The first five blocks of each question whose lines overlap a gold block's."""
    ranking, gold, _ = _answered(s, d)
    lines = retrieve._library(s, d)[1].where("source_start_line > 0 and source_end_line > 0").select(F.col("parent_id").alias("answer"), "doc_id", "source_start_line", "source_end_line")
    cited = merged(ranking.where("rank <= 5"), lines, "answer").select("query_id", "doc_id", F.col("answer").alias("parent_id"), F.col("source_start_line").alias("a"), F.col("source_end_line").alias("z"))
    return overlapping_lines(cited, merged(gold, lines, "answer").select("query_id", "doc_id", F.col("source_start_line").alias("ga"), F.col("source_end_line").alias("gz")))


def a11_rank_agreement(s: SparkSession, d: str) -> DataFrame:
    """Agreement of two whole rankings of each host's notes, the hot host's among them."""
    r = _ranking(s, d)
    by = lambda c: r.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), "answer"))).select("query_id", "answer", "rank")
    return rank_agreement(by("file_size"), by("mtime"))


def j15_gold_join(s: SparkSession, d: str) -> DataFrame:
    """Gold questions with the notes they expect, by the note's file name."""
    g = table(s, d, "core_gold").where("expected.doc is not null").select("id", F.col("expected.doc").alias("name")).distinct()
    n = table(s, d, "documents").select("doc_id", F.substring_index("rel_path", "/", -1).alias("name"))
    return g.join(n, "name").select("id", "doc_id")


def a10_guard_rate(s: SparkSession, d: str) -> DataFrame:
    """Per category the share of questions that name a relation, and of those without an answer."""
    g = table(s, d, "core_gold").select("id", "category", F.col("expected.relation").isNotNull().alias("rel"), (F.col("expected.answer_state") == "insufficient").alias("none")).distinct()
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return g.groupBy("category").agg(F.count(F.lit(1)).alias("n"), rate("rel").alias("relation_rate"), rate("none").alias("no_answer_rate"))


QUERIES = {f.__name__: f for f in [a7_retrieval_metrics, a7_search_metrics, a13_failures, j10_cited_lines, a10_guard_rate, a11_rank_agreement, j15_gold_join]}
_CITED = retrieve._BM25 + """, b0 as (select lower(trim(parent_id)) p, arg_max(struct_pack(doc := lower(trim(doc_id)), content := content, a := source_start_line, z := source_end_line), struct_pack(t := coalesce(indexed_at, timestamp '1970-01-01'), c := content)) b from parent_blocks where parent_id is not null group by 1), b as (select p, b.doc, b.content, b.a, b.z from b0),
 k as (select distinct on (chunk_id) chunk_id, lower(trim(parent_id)) p from chunks where content is not null), r as (select query_id, p, row_number() over (partition by query_id order by min(score), p) rank from s join k using (chunk_id) where p is not null group by 1, 2),
 g0 as (select id query_id, min(expected.doc) doc, min(expected.must_contain) m from core_gold where expected.doc is not null and len(expected.must_contain) > 0 group by 1), g1 as (select g0.* from g0 join q using (query_id)),
 n as (select lower(trim(doc_key)) doc_id, regexp_extract(rel_path, '[^/]*$', 0) doc from documents), g2 as (select query_id, p, b.doc dkey, b.a, b.z, len(list_filter(m, lambda w: contains(lower(content), lower(w)))) held, len(m) need from g1 join n using (doc) join b on b.doc = n.doc_id),
 g as (select distinct query_id, p, dkey, a, z from (select *, bool_or(held = need) over (partition by query_id) any_ from g2 where held > 0) where held = need or not any_), f as (select g.query_id, min(rank) f from g left join r on r.query_id = g.query_id and r.p = g.p and rank <= 30 group by 1)"""
SQL = {
    "a7_retrieval_metrics": _CITED + " select count(*) as n, round(avg((coalesce(f, 99) <= 1)::int), 6) as recall_1, round(avg((coalesce(f, 99) <= 3)::int), 6) as recall_3, round(avg((coalesce(f, 99) <= 5)::int), 6) as recall_5, round(avg(coalesce(1.0::double / f, 0)), 6) as mrr from f",
    "a13_failures": _CITED + " select case when f.query_id is null then 'none' when f is null then 'recall' when f > 5 then 'rerank' else 'ok' end as class, count(*) as n from q left join f using (query_id) group by 1",
    "j10_cited_lines": _CITED + " select distinct r.query_id, r.p as parent_id from r join b c on c.p = r.p join g on g.query_id = r.query_id and g.dkey = c.doc where rank <= 5 and c.a > 0 and c.z > 0 and g.a > 0 and g.z > 0 and c.a <= g.z and c.z >= g.a",
    "a10_guard_rate": "with g as (select distinct id, category, expected.relation is not null r, expected.answer_state = 'insufficient' i from core_gold) select category, count(*) as n, round(avg(r::int), 6) as relation_rate, round(avg(i::int), 6) as no_answer_rate from g group by 1",
    "a11_rank_agreement": """with a as (select host, doc_id, row_number() over (partition by host order by file_size desc, doc_id) r from documents where host is not null), b as (select host, doc_id, row_number() over (partition by host order by mtime desc, doc_id) r from documents where host is not null),
 h as (select host, list_sort(list(doc_id) filter (r <= 1)) h1, list_sort(list(doc_id) filter (r <= 3)) h3 from a group by 1), i as (select host, list_sort(list(doc_id) filter (r <= 1)) h1, list_sort(list(doc_id) filter (r <= 3)) h3 from b group by 1),
 t as (select host, doc_id, a.r ra, b.r rb from a join b using (host, doc_id) ), p as (select round(avg((x.rb < y.rb)::int), 6) pair_order from t x join t y on x.host = y.host and x.ra < y.ra)
 select (select round(avg((h.h1 = i.h1)::int), 6) from h join i using (host)) as top_1, (select round(avg((h.h3 = i.h3)::int), 6) from h join i using (host)) as top_3, pair_order from p""",
    "j15_gold_join": "with g as (select distinct id, expected.doc n from core_gold where expected.doc is not null) select id, doc_id from g join documents on regexp_extract(rel_path, '[^/]*$', 0) = n",
}
