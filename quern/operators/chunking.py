"""Notes to parents and children, one pass per note, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markdown as M
from quern.functions.text import doc_id_of, retrieval_text
from quern.plans.question_sql import units_sql
from quern.session import table

_PARENTS = "doc_id string, parent_id string, ord int, content string, section_path string, source_start_line int, source_end_line int, children array<string>, first_child int"


def parse_notes(notes: DataFrame) -> DataFrame:
    """Parents of notes (``rel_path, text``), with their children as an array and the number of children before them.

    Null and empty texts have no parents. Ids come from the path, so they are the
    same in every run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("parent_id", pa.string()), ("ord", pa.int32()), ("content", pa.string()), ("section_path", pa.string()), ("source_start_line", pa.int32()), ("source_end_line", pa.int32()), ("children", pa.list_(pa.string())), ("first_child", pa.int32())])
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = 0
                for i, p in enumerate(M.parse_note(t) if t else ()):
                    rows.append((d, f"{d}:p{i}", i, p.content, p.section_path, p.first_line, p.last_line, p.children, n))
                    n += len(p.children)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return notes.select(doc_id_of(F.col("rel_path")).alias("doc_id"), "text").mapInArrow(run, _PARENTS)


def children(parents: DataFrame) -> DataFrame:
    """Children with an id that counts through the note, from the number each parent begins with; no shuffle."""
    x = parents.select("doc_id", "parent_id", "section_path", F.col("first_child").alias("_before"), F.posexplode("children").alias("pos", "content"))
    no = F.col("_before") + F.col("pos")
    return x.select(F.concat("doc_id", F.lit(":c"), no.cast("string")).alias("chunk_id"), no.cast("int").alias("chunk_ord"), "doc_id", "parent_id", "content", "section_path", retrieval_text(F.col("section_path"), F.col("content")).alias("retrieval_text"))


def units(parents: DataFrame) -> DataFrame:
    """Evidence units of parents: ``parent_id, no, kind, line, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["parent_id", "no", "kind", "line", "text"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            rows = [(p, i, k, n, t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (t, k, n) in enumerate(M.evidence_units(c))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return parents.select("parent_id", "content").mapInArrow(run, "parent_id string, no int, kind string, line int, text string")


def c1_parse(s: SparkSession, d: str) -> DataFrame:
    return parse_notes(table(s, d, "documents")).select("parent_id", "ord", "section_path", "source_start_line", "source_end_line", F.length("content").alias("n_chars"))


def c8_children(s: SparkSession, d: str) -> DataFrame:
    return children(parse_notes(table(s, d, "documents"))).select("chunk_id", "chunk_ord", "parent_id", F.length("content").alias("n_chars"))


def c14_units(s: SparkSession, d: str) -> DataFrame:
    """Evidence units of every block by kind."""
    b = table(s, d, "parent_blocks").where("parent_id is not null").groupBy("parent_id").agg(F.max("content").alias("content"))
    return units(b).groupBy("parent_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def c_tables_in_blocks(s: SparkSession, d: str) -> DataFrame:
    """Tables and their rows in blocks, counted by built-in expressions."""
    lines = F.split("content", "\n")
    rows = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\|.*\|\s*$")))
    rules = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\|[\s:|-]+\|\s*$")))
    b = table(s, d, "parent_blocks").where("content is not null").select("parent_id", rows.cast("long").alias("table_lines"), rules.cast("long").alias("rules")).where("rules > 0")
    return b.distinct()


QUERIES = {"c1_parse": c1_parse, "c8_children": c8_children, "c14_units": c14_units, "c10_table_lines": c_tables_in_blocks}
SQL = {
    "c14_units": "with " + units_sql("select parent_id, max(content) content from parent_blocks where parent_id is not null and content is not null group by 1") + " select parent_id, kind, count(*) as n, sum(length(text)) as n_chars from u group by 1, 2",
    "c10_table_lines": "with l as (select parent_id, string_split(content, chr(10)) l from parent_blocks where content is not null), c as (select parent_id, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$'))) as table_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*\\|[\\s:|-]+\\|\\s*$'))) as rules from l) select distinct * from c where rules > 0",
}
