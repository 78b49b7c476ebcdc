"""What is shown of the evidence: windows, highlights, table excerpts, prompts and answers without a model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.query import highlight_terms
from quern.functions.text import question_type, snippet
from quern.session import table

#: Characters per block and in all, and the least room for another block.
PER_BLOCK, TOTAL, ROOM = 400, 1800, 80
#: The same for overviews.
WIDE_BLOCK, WIDE_TOTAL = 900, 4000
#: Marks around a highlighted term.
OPEN, CLOSE = "\x01", "\x02"


def window(text: str, terms: list[str], limit: int) -> str:
    """A stretch around the longest term that occurs, a third of it before the term; the start if none does."""
    low = text.lower()
    at = next((i for t in sorted(terms, key=len, reverse=True) if (i := low.find(t.lower())) >= 0), 0)
    start = max(0, at - limit // 3)
    return text[start : start + limit]


def highlight(text: str, terms: list[str]) -> str:
    """Terms between marks, longer ones first, without regard to letter case."""
    if not terms:
        return text
    pattern = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return re.sub(f"(?i){pattern}", lambda m: OPEN + m[0] + CLOSE, text)


def table_excerpt(text: str, terms: list[str], most: int = 6) -> str:
    """The head of a table, rows with a term and the rows next to them."""
    rows = [x for x in text.splitlines() if x.strip().startswith("|")]
    if len(rows) < 3:
        return ""
    body = rows[2:]
    hit = [any(t.lower() in r.lower() for t in terms) for r in body]
    near = [i for i in range(len(body)) if any(hit[max(0, i - 1) : i + 2])]
    return "\n".join(rows[:2] + [body[i] for i in near[:most]]) if near else ""


def prompt_blocks(blocks: list[str], terms: list[str], per_block: int = PER_BLOCK, total: int = TOTAL) -> list[str]:
    """Windows of ranked blocks while they fit the budget; what is left of it limits the next."""
    out, left = [], total
    for b in blocks:
        if left < ROOM:
            break
        w = window(b, terms, min(per_block, left))
        out.append(w)
        left -= len(w)
    return out


def offline_answer(terms: list[str], blocks: list[tuple[str, str]]) -> str:
    """An answer from the evidence alone: three excerpts of 300 characters with their numbers."""
    if not blocks:
        return "未找到相关资料。"
    parts = [f"[{i}] {title}\n{highlight(table_excerpt(text, terms) or window(text, terms, 300), terms)}" for i, (title, text) in enumerate(blocks[:3], 1)]
    return "\n\n".join(parts)


def prompts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """``query_id, prompt, n_blocks, answer`` of questions and their ranked blocks (``query_id, ref, title, content``)."""
    blocks = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ref", "title", "content"))).alias("blocks"))
    wide = (question_type(F.col("query")) == "coverage").alias("wide")
    x = queries.select("query_id", highlight_terms(F.col("query")).alias("terms"), wide).join(blocks, "query_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for terms, wide, parts in zip(*[c.to_pylist() for c in b.columns[1:]]):
                own = [(p["title"] or "", p["content"] or "") for p in parts or []]
                texts = prompt_blocks([t for _, t in own], terms or [], *((WIDE_BLOCK, WIDE_TOTAL) if wide else (PER_BLOCK, TOTAL)))
                out.append(("\n\n".join(f"[{i}] {own[i - 1][0]}\n{t}" for i, t in enumerate(texts, 1)), len(texts), offline_answer(terms or [], own)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out])], ["query_id", "prompt", "n_blocks", "answer"])

    t = queries.schema["query_id"].dataType.simpleString()
    return x.mapInArrow(run, f"query_id {t}, prompt string, n_blocks int, answer string")


def v16_snippets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", snippet(F.col("text"), F.lit("report")).alias("snippet"))


def v18_highlights(s: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("title", F.lit("")), "(?i)(report|notes|log)", "<$1>")
    return table(s, d, "documents").select("doc_id", t.alias("marked"))


def v20_prompts(s: SparkSession, d: str) -> DataFrame:
    """A prompt for each note from its blocks in order, with the note's title as question."""
    k = lambda c: F.lower(F.trim(F.col(c)))
    q = table(s, d, "documents").where("title is not null").select(k("doc_key").alias("query_id"), F.col("title").alias("query"))
    b = table(s, d, "parent_blocks").where("doc_id is not null and parent_id is not null").dropDuplicates(["parent_id"]).select(k("doc_id").alias("query_id"), F.col("ord").alias("ref"), "parent_id", F.col("section_path").alias("title"), "content")
    # Blocks behind those that fill the largest budget are in no prompt, whatever the windows.
    before = F.sum(F.least(F.coalesce(F.length("content"), F.lit(0)), F.lit(PER_BLOCK))).over(W.partitionBy("query_id").orderBy("ref", "parent_id").rowsBetween(W.unboundedPreceding, -1))
    near = b.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("ref", "parent_id"))).withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < WIDE_TOTAL) | (F.col("n") <= 3))
    return prompts(q, near).select("query_id", "n_blocks", F.length("prompt").alias("n_chars"), F.length("answer").alias("answer_chars"))


QUERIES = {"v16_snippets": v16_snippets, "v18_highlights": v18_highlights, "v20_prompts": v20_prompts}
SQL = {
    "v16_snippets": "select doc_id, substring(text, greatest(strpos(text, 'report') - 1 - 46, 0) + 1, 140) as snippet from documents where text is not null",
    "v18_highlights": "select doc_id, regexp_replace(coalesce(title, ''), '(?i)(report|notes|log)', '<\\1>', 'g') as marked from documents",
}
