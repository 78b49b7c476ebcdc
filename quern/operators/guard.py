"""Checks of claimed relations against retrieved blocks, for batches of questions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import relation as R
from quern.plans import question_sql as SQ
from quern.session import table

#: Blocks of a question that are looked at; the retrieval returns no more.
BLOCKS = 20


def routes(queries: DataFrame) -> DataFrame:
    """``query_id, guarded, kind, anchor, target`` of questions, by the first form that fits; null and blank questions pass."""
    q = F.trim(F.coalesce("query", F.lit("")))
    fits = [q.rlike(f.replace("(?P<", "(?<")) for _, _, f in R.FORMS]
    passed = (q == "") | q.rlike("|".join(f"(?:{p})" for p in R.PASS))

    def first(value):  # noqa: ANN001, ANN202
        out = F.when(passed, value(None, False, None))
        for fit, (kind, guarded, form) in zip(fits, R.FORMS):
            out = out.when(fit, value(kind, guarded, form))
        return out.otherwise(value(None, False, None))

    def part(name: str):  # noqa: ANN202
        def of(kind, guarded, form):  # noqa: ANN001, ANN202
            at = re.compile(form).groupindex.get(name) if form else None
            return F.trim(F.regexp_extract(q, form.replace("(?P<", "(?<"), at)) if at else F.lit("")

        return first(of)

    return queries.select("query_id", first(lambda k, g, f: F.lit(g)).alias("guarded"), first(lambda k, g, f: F.lit(k or "")).alias("kind"), part("a").alias("anchor"), part("t").alias("target"))


def verdicts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Verdicts of questions over their ranked blocks (``query_id, ref, parent_id, section_path, content``)."""
    blocks = ranked.where(F.col("ref") <= BLOCKS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ref", "parent_id", "section_path", "content"))).alias("blocks"))
    asked = queries.select("query_id", "query").join(blocks, "query_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, parts in zip(pdf["query"], pdf["blocks"]):
                r = R.analyze_relation(q)
                v = R.evaluate(r, [(p["parent_id"], p["section_path"], p["content"]) for p in (parts if parts is not None else [])])
                out.append((v.verdict, v.rule, v.owner, v.unit, v.parent_id, "" if v.verdict == "YES" else R.blocked_message(r, v)))
            yield pd.DataFrame(out, columns=["verdict", "rule", "owner", "unit", "parent_id", "message"]).assign(query_id=pdf["query_id"].to_numpy())[["query_id", "verdict", "rule", "owner", "unit", "parent_id", "message"]]

    t = queries.schema["query_id"].dataType.simpleString()
    return asked.mapInPandas(run, f"query_id {t}, verdict string, rule string, owner string, unit string, parent_id string, message string")


def g1_routes(s: SparkSession, d: str) -> DataFrame:
    """Routes of all gold questions, and of a question of each form about each block's section."""
    q = table(s, d, "core_gold").select(F.col("id").alias("query_id"), "query").distinct()
    tail = F.regexp_extract("section_path", "([^>]*)$", 1)
    asked = F.element_at(F.array(*[F.concat(F.lit(a), tail, F.lit(b)) for a, b in ASKED]), (F.pmod(F.length("parent_id") + F.col("ord"), F.lit(len(ASKED))) + 1).cast("int"))
    own = table(s, d, "parent_blocks").where("parent_id is not null and section_path <> ''").select(F.col("parent_id").alias("query_id"), asked.alias("query")).distinct()
    return routes(q.unionByName(own))


def g4_verdicts(s: SparkSession, d: str) -> DataFrame:
    """A responsibility question about the section of each block, judged by that block."""
    b = table(s, d, "parent_blocks").where("content is not null and parent_id is not null").groupBy("parent_id").agg(F.max("content").alias("content"), F.max("section_path").alias("section_path"))
    q = b.select(F.col("parent_id").alias("query_id"), F.concat(F.trim(F.regexp_extract(F.coalesce("section_path", F.lit("")), "([^>]*)$", 1)), F.lit("由谁负责？")).alias("query"))
    ranked = b.select(F.col("parent_id").alias("query_id"), F.lit(1).alias("ref"), "parent_id", "section_path", "content")
    return verdicts(q, ranked).select("query_id", "verdict", "rule", "owner")


def g2_owners(s: SparkSession, d: str) -> DataFrame:
    """Names before 负责 in blocks, by built-in expressions in the order of the patterns."""
    first = [F.regexp_extract("content", p, 1) for p in R.OWNERS]
    owner = F.coalesce(*[F.when(x != "", x) for x in first])
    b = table(s, d, "parent_blocks").where("content is not null").select("parent_id", owner.alias("owner")).where("owner is not null")
    return b.distinct()


#: What stands before and behind a name in the questions that are made of sections.
ASKED = [("谁负责", "？"), ("", "由谁负责？"), ("", "是否导致停工？"), ("哪个原因造成", "？"), ("", "的型号是多少？"), ("", "有哪些影响？"), ("", "的职责是什么？"), ("", "")]

QUERIES = {"g1_routes": g1_routes, "g2_owners": g2_owners, "g4_verdicts": g4_verdicts}
_OWN = ", ".join(f"nullif(regexp_extract(content, '{p}', 1), '')" for p in R.OWNERS)
_CASES = [(f"regexp_matches(q, '{f}')", g, k, *[re.compile(f).groupindex.get(n) for n in ("a", "t")], f) for k, g, f in R.FORMS]
_PASSED = "q = '' or " + " or ".join(f"regexp_matches(q, '{p}')" for p in R.PASS)
_first = lambda value, none: f"case when {_PASSED} then {none} " + " ".join(f"when {c[0]} then {value(c)}" for c in _CASES) + f" else {none} end"
_part = lambda at: _first(lambda c: f"trim(regexp_extract(q, '{c[5]}', {c[at]}))" if c[at] else "''", "''")
_ASKED = " ".join(f"when {i} then '{a}' || t || '{b}'" for i, (a, b) in enumerate(ASKED))
SQL = {
    "g1_routes": f"""with s as (select distinct parent_id, ord, regexp_extract(section_path, '([^>]*)$', 1) t from parent_blocks where parent_id is not null and section_path <> ''),
 x as (select distinct id query_id, query from core_gold union all select distinct parent_id, case (length(parent_id) + ord) % {len(ASKED)} {_ASKED} end from s), y as (select query_id, trim(coalesce(query, '')) q from x)
 select query_id, {_first(lambda c: str(c[1]).lower(), "false")} as guarded, {_first(lambda c: f"'{c[2]}'", "''")} as kind, {_part(3)} as anchor, {_part(4)} as target from y""",
    "g4_verdicts": "with " + SQ.units_sql("select parent_id, max(content) content from parent_blocks where content is not null and parent_id is not null group by 1") + f""", s as (select parent_id, trim(regexp_extract(coalesce(max(section_path), ''), '([^>]*)$', 1)) || '由谁负责？' q from parent_blocks where content is not null and parent_id is not null group by 1),
 r as (select parent_id, q, {_first(lambda c: str(c[1]).lower(), "false")} guarded, {_part(3)} anchor from s), m as (select r.parent_id, u.no, coalesce({_OWN.replace("content", "u.text")}) owner, row_number() over (partition by r.parent_id order by u.no) k from r join u on u.parent_id = r.parent_id where anchor <> '' and contains(u.text, anchor)),
 f as (select parent_id, count(*) n, arg_min(owner, k) filter (owner is not null) owner from m group by 1)
 select r.parent_id as query_id, case when not guarded or f.owner is not null then 'YES' else 'INSUFFICIENT' end as verdict, case when not guarded then 'not checked' when f.owner is not null then 'owner named' when f.n > 0 then 'found apart' else 'not found' end as rule, case when guarded then coalesce(f.owner, '') else '' end as owner from r left join f using (parent_id)""",
    "g2_owners": f"with o as (select parent_id, coalesce({_OWN}) as owner from parent_blocks where content is not null) select distinct parent_id, owner from o where owner is not null",
}
