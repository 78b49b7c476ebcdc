"""Further operators of the inventory as queries: sources and sinks, term resolution, assembly, small joins and folds."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import query as Q
from quern.functions import text as X
from quern.functions.paths import address_kind
from quern.operators import vector
from quern.operators.lexical import distinct_runs, match_terms, present_terms
from quern.operators.retrieve import SUBTERMS, minimal_cover, subterms, trims
from quern.operators.skew import merged
from quern.plans import question_sql as SQ
from quern.plans.scalar import URL_SQL
from quern.session import table
from quern.sources.convert import convert, decode


def _k(c: str):  # noqa: ANN202
    return F.lower(F.trim(F.col(c)))


def s4_decoded(s: SparkSession, d: str) -> DataFrame:
    """Texts as bytes in an encoding by their number, read back by the converter's chain of encodings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [("utf-8", "utf-8-sig", "gb18030")[i % 3] for i in b.column(0).to_pylist()]
            texts = [decode(t.encode(n))[0] for n, t in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    got = table(s, d, "documents").where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
    return got.select("doc_id", F.md5("text").alias("h"))


def _squeezed(t: str) -> str:
    return "".join(c for c in t.casefold() if c.isalnum())


def _packed(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def _office(kind: str, text: str) -> bytes:
    """The least file of a kind that holds a text."""
    t = escape(text)
    if kind == "docx":
        return _packed({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:body></w:document>'})
    if kind == "pptx":
        return _packed({"ppt/slides/slide1.xml": f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:t>Head</a:t><a:t>{t}</a:t></p>'})
    if kind == "epub":
        return _packed({"META-INF/container.xml": '<c><rootfile full-path="p.opf"/></c>', "p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>', "a.html": f"<p>{t}</p>"})
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = f'<workbook xmlns="{sheet}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    return _packed({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{sheet}"><sheetData><row><c r="A1" t="inlineStr"><is><t>{t}</t></is></c></row></sheetData></worksheet>'})


#: Extensions with the bytes of a file that holds a text.
FORMATS = [
    ("txt", str.encode), ("md", str.encode), ("py", lambda t: f"x = 1  # {t}".encode()), ("json", lambda t: json.dumps({"a": t}).encode()), ("jsonl", lambda t: (json.dumps({"a": t}, ensure_ascii=False) + "\n").encode()), ("yaml", lambda t: f"a: |\n  {t}".encode()),
    ("xml", lambda t: f"<a><b>{escape(t)}</b></a>".encode()), ("csv", lambda t: ("a,b\n1," + '"' + t.replace('"', '""') + '"').encode()), ("srt", lambda t: f"1\n00:00:01,000 --> 00:00:02,000\n{t}\n".encode()), ("rtf", lambda t: ("{\\rtf1 " + "".join(c if c.isascii() and c not in "{}\\" else f"\\u{ord(c) if ord(c) < 32768 else ord(c) - 65536}?" if ord(c) < 65536 and c not in "{}\\" else "" for c in t) + "}").encode()),
    ("html", lambda t: f"<html><body><p>{escape(t)}</p></body></html>".encode()), ("eml", lambda t: b"From: a@b\nSubject: x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + t.encode()), ("mhtml", lambda t: b"MIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + f"<p>{escape(t)}</p>".encode()),
    ("docx", lambda t: _office("docx", t)), ("pptx", lambda t: _office("pptx", t)), ("xlsx", lambda t: _office("xlsx", t)), ("epub", lambda t: _office("epub", t)),
]


def s3_converted(s: SparkSession, d: str) -> DataFrame:
    """Titles as files of every readable format by turns, through the converter: whether it read them, and whether the text is in what it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ext, make = FORMATS[i % len(FORMATS)]
                r = convert(make(t), f"f{i}.{ext}")
                out.append((ext, r.ok, _squeezed(t) in _squeezed(r.markdown)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])], ["doc_id", "format", "ok", "holds"])

    # Words alone: what a format's own marks do to other characters is not asked here.
    words = F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}]+", " "))
    t = table(s, d, "documents").select("doc_id", words.alias("t")).where("t <> ''").where(~F.col("t").rlike(r"[^\x{0}-\x{ffff}]"))
    return t.mapInArrow(run, "doc_id long, format string, ok boolean, holds boolean")


def s10_tables(s: SparkSession, d: str) -> DataFrame:
    """Notes of a folder as CSV files through the converter."""
    t = table(s, d, "documents").where("title is not null").groupBy(F.substring_index("rel_path", "/", 1).alias("folder"), F.pmod("doc_id", F.lit(50)).alias("part"))
    files = t.agg(F.concat(F.lit("id,status\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "status"))), lambda x: F.concat_ws(",", x.doc_id.cast("string"), F.coalesce(x.status, F.lit("")))), "\n")).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [convert(x, "notes.csv") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.ok for x in r]), pa.array([x.markdown.count("\n| ") - 2 for x in r], pa.int64())], ["folder", "part", "ok", "rows"])

    return files.mapInArrow(run, "folder string, part long, ok boolean, rows long")


def s20_clipped(s: SparkSession, d: str) -> DataFrame:
    """Texts over 2000 characters cut with a notice."""
    t = F.coalesce("text", F.lit(""))
    clip = F.when(F.length(t) > 2000, F.concat(F.substring(t, 1, 2000), F.lit("\n\n> cut"))).otherwise(t)
    return table(s, d, "documents").select("doc_id", F.length(clip).alias("n"))


def s26_captures(s: SparkSession, d: str) -> DataFrame:
    """Captures by what became of them: duplicates of an address, thin pages, full pages."""
    c = table(s, d, "conversion_results").where("kind = 'html' and source_url is not null").select("conv_id", "ok", "markdown", X.normalize_url(F.col("source_url")).alias("url")).dropDuplicates(["conv_id"])
    first = F.row_number().over(W.partitionBy("url").orderBy("conv_id"))
    state = F.when(~F.col("ok"), "failed").when(F.col("n") > 1, "duplicate").when(F.coalesce(F.length("markdown"), F.lit(0)) < 150, "partial_fallback").otherwise("success")
    return c.withColumn("n", first).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("pages"))


def sel_p2_by_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_id = 10").select("doc_id", "title", "rel_path")


def sel_p7_exists(s: SparkSession, d: str) -> DataFrame:
    """Which of the words answers must hold occur in some chunk."""
    t = table(s, d, "holdout_b_gold").select(F.explode("expected.must_contain").alias("term")).select(F.lower("term").alias("term")).distinct()
    hits = match_terms(t, table(s, d, "chunks"), "chunk_id", "content").select("term").distinct()
    return t.join(hits.withColumn("found", F.lit(True)), "term", "left").select("term", F.coalesce("found", F.lit(False)).alias("found"))


def j7_full_outer(s: SparkSession, d: str) -> DataFrame:
    """Notes per source and per collection of gold questions, whichever side has one."""
    a = table(s, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("notes"))
    b = table(s, d, "core_gold").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("questions"))
    return a.join(b, "source", "full_outer")


def j11_semi_anti(s: SparkSession, d: str) -> DataFrame:
    """Blocks with and without child texts."""
    b = table(s, d, "parent_blocks").where("parent_id is not null").select(_k("parent_id").alias("p")).distinct()
    c = table(s, d, "chunks").where("parent_id is not null").select(_k("parent_id").alias("p")).distinct()
    a = b.join(c, "p", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("with"))
    return a.unionByName(b.join(c, "p", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("without")))


def a1_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_metadata").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.max("char_len").alias("longest"))


def w5_section_diversity(s: SparkSession, d: str) -> DataFrame:
    """Blocks of a note in an order that takes one of each section before a second of any."""
    b = table(s, d, "parent_blocks").where("doc_id is not null and section_path <> ''").groupBy(_k("doc_id").alias("doc"), "parent_id").agg(F.min("ord").alias("ord"), F.min("section_path").alias("sp"))
    turn = F.row_number().over(W.partitionBy("doc", "sp").orderBy("ord", "parent_id"))
    place = F.row_number().over(W.partitionBy("doc").orderBy("turn", "ord", "parent_id"))
    return b.withColumn("turn", turn).select("doc", "parent_id", place.alias("place")).where("place <= 5")


def w7_packing(s: SparkSession, d: str) -> DataFrame:
    """Blocks of text packed greedily to 800 characters by a fold over the array."""
    parts = F.filter(F.split("text", "\n{2,}"), lambda x: F.trim(x) != "")
    start = F.struct(F.lit(0).alias("room"), F.lit(0).alias("n"))
    fold = F.aggregate(F.transform(parts, F.length), start, lambda a, x: F.when((a.n > 0) & (a.room + x + 2 <= 800), F.struct((a.room + x + 2).alias("room"), a.n.alias("n"))).otherwise(F.struct(x.alias("room"), (a.n + 1).alias("n"))))
    return table(s, d, "documents").where("text is not null").select("doc_id", fold.n.alias("parents"))


def w13_most_per_note(s: SparkSession, d: str) -> DataFrame:
    """Chunks with a word, at most two of a note."""
    c = table(s, d, "chunks").where("doc_id is not null and content like '%value%'").select(_k("doc_id").alias("doc"), "chunk_id").distinct()
    return c.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy("chunk_id"))).where("k <= 2").select("doc", "chunk_id")


def t2_stable_sort(s: SparkSession, d: str) -> DataFrame:
    """The hundred longest children, ties in the order of their ids."""
    c = table(s, d, "chunk_metadata").where("char_len is not null").groupBy("chunk_id").agg(F.max("char_len").alias("n"))
    return c.orderBy(F.desc("n"), "chunk_id").limit(100)


def u2_candidates(s: SparkSession, d: str) -> DataFrame:
    """Notes that are in the trash or have a failed status, each once."""
    a = table(s, d, "trash").select(_k("doc_id").alias("doc"))
    b = table(s, d, "documents").where("status <> 'success'").select(_k("doc_key").alias("doc"))
    return a.union(b).distinct()


def u4_minimal_cover(s: SparkSession, d: str) -> DataFrame:
    """Words of titles without those that hold another word of the title."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), 0))
    keep = F.filter(w, lambda x: ~F.exists(w, lambda y: (y != x) & x.contains(y)))
    return table(s, d, "documents").where("title is not null").select("doc_id", F.array_join(F.slice(keep, 1, 8), "|").alias("words"))


def q5_content_terms(s: SparkSession, d: str) -> DataFrame:
    """Content terms, scope, target and highlights of all questions."""
    q = table(s, d, "core_gold").select("id", "query").distinct()
    c = F.col("query")
    parts = {"terms": Q.content_terms(c), "written": Q.written_terms(c), "scope": Q.runs(c, "S"), "target": Q.runs(c, "T"), "marks": Q.highlight_terms(c)}
    return q.select("id", *[F.array_join(v, "|").alias(k) for k, v in parts.items()])


def q15_trimmed_terms(s: SparkSession, d: str) -> DataFrame:
    """Each Chinese run of all questions as the corpus holds it: its longest beginning, else its longest end.

    All candidates of all questions meet the chunks in one pass.
    """
    runs = table(s, d, "core_gold").select(F.explode(Q.tokens(F.col("query"))).alias("run")).where(Q.is_chinese(F.col("run")) & (F.length("run") >= 2)).distinct()
    held, longest = distinct_runs(table(s, d, "chunks"), "content", Q.RUN)
    c = runs.select("run", F.posexplode(trims(F.col("run"), longest)).alias("at", "term"))
    known = present_terms(c.select("term"), held, "low")
    return merged(c, known, "term").groupBy("run").agg(F.min_by("term", "at").alias("term"))


def q16_corpus_grams(s: SparkSession, d: str) -> DataFrame:
    """Each Chinese run of three and more characters of all questions as the least subterms that chunks hold."""
    runs = table(s, d, "core_gold").select(F.explode(Q.content_terms(F.col("query"))).alias("run")).where(Q.is_chinese(F.col("run")) & (F.length("run") > 2)).distinct()
    c = runs.select("run", F.posexplode(subterms(F.col("run"))).alias("at", "term"))
    known = present_terms(c.select("term"), table(s, d, "chunks"), "content", Q.RUN)
    held = c.join(known, "term").groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x.term).alias("a"))
    return held.select("run", F.array_join(F.slice(minimal_cover(F.col("a")), 1, SUBTERMS), "|").alias("terms"))


def v7_similarity_bands(s: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours by bands of similarity."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    sim = vector.similarity(F.col("distance"))
    return vector.nearest(e, q, 5).groupBy(F.floor(sim * 10).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(sim >= vector.SEMANTIC_FLOOR).alias("grounded"))


def x18_addresses(s: SparkSession, d: str) -> DataFrame:
    """Kinds of the hosts that pages come from."""

    @F.pandas_udf("string")
    def kind(c):  # noqa: ANN001, ANN202
        return c.map(address_kind)

    h = table(s, d, "conversion_results").where("source_url is not null").select(X.host_of(F.col("source_url")).alias("host")).distinct()
    return h.groupBy(kind("host").alias("kind")).agg(F.count(F.lit(1)).alias("hosts"))


def x23_evidence_phrases(s: SparkSession, d: str) -> DataFrame:
    """The first six phrases of four and more characters of a block, without Markdown marks."""
    bare = F.regexp_replace("content", r"[*_`#>|\[\]()]", " ")
    parts = F.slice(F.filter(F.transform(F.split(bare, r"[\n.,;:!?。，；：！？]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4), 1, 6)
    b = table(s, d, "parent_blocks").where("content is not null").select("parent_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("phrases"))
    return b.distinct()


def l3_display_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles set by the user in a map, taken where there is one."""
    n = table(s, d, "documents").select("doc_id", F.map_from_arrays(F.array(F.lit("title")), F.array(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("* "), F.col("title"))))).alias("own"), "title")
    return n.select("doc_id", F.coalesce(F.col("own")["title"], F.col("title"), F.lit("")).alias("shown"))


def r5_upserts(s: SparkSession, d: str) -> DataFrame:
    """The newest row of each event's user and type, as an upsert of batches would leave it."""
    e = table(s, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


QUERIES = {f.__name__: f for f in [s3_converted, s4_decoded, s10_tables, s20_clipped, s26_captures, sel_p2_by_key, sel_p7_exists, j7_full_outer, j11_semi_anti, a1_counts, w5_section_diversity, w7_packing, w13_most_per_note, t2_stable_sort, u2_candidates, u4_minimal_cover, q5_content_terms, q15_trimmed_terms, q16_corpus_grams, v7_similarity_bands, x18_addresses, x23_evidence_phrases, l3_display_titles, r5_upserts]}

_CJK = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}"
_URL = "regexp_replace(source_url, '[?#].*$', '')"
SQL = {
    "s3_converted": f"with t as (select doc_id, trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) t from documents) select doc_id, {[f for f, _ in FORMATS]}[doc_id % {len(FORMATS)} + 1] as format, true as ok, true as holds from t where t <> '' and not regexp_matches(t, '[\\x{{10000}}-\\x{{10ffff}}]')",
    "s4_decoded": "select doc_id, md5(text) as h from documents where text <> ''",
    "s26_captures": f"""with c as (select conv_id, any_value(ok) ok, any_value(markdown) markdown, any_value({URL_SQL}) url from conversion_results where kind = 'html' and source_url is not null group by 1), n as (select *, row_number() over (partition by url order by conv_id) n from c)
 select case when not ok then 'failed' when n > 1 then 'duplicate' when coalesce(length(markdown), 0) < 150 then 'partial_fallback' else 'success' end as state, count(*) as pages from n group by 1""",
    "w7_packing": """with p as (select doc_id, list_filter(regexp_split_to_array(text, '\\n{2,}'), lambda x: trim(x) <> '') p from documents where text is not null)
 select doc_id, list_reduce(list_transform(p, lambda x: {'room': length(x), 'n': 0}), lambda a, x: case when a.n > 0 and a.room + x.room + 2 <= 800 then {'room': a.room + x.room + 2, 'n': a.n} else {'room': x.room, 'n': a.n + 1} end, {'room': 0::bigint, 'n': 0}).n as parents from p""",
    "x18_addresses": """with h as (select distinct lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) h from conversion_results where source_url is not null)
 select case when h in ('localhost', '') or regexp_matches(h, '[.](local|internal)$') or regexp_matches(h, '^(10|127)[.]|^192[.]168[.]|^169[.]254[.]') then 'private' when regexp_matches(h, '^[0-9]+([.][0-9]+){3}$') then 'public' else 'name' end as kind, count(*) as hosts from h group by 1""",
    "s10_tables": "select split_part(rel_path, '/', 1) as folder, doc_id % 50 as part, true as ok, count(*) as rows from documents where title is not null group by 1, 2",
    "s20_clipped": "select doc_id, case when length(text) > 2000 then 2007 else coalesce(length(text), 0) end as n from documents",
    "sel_p2_by_key": "select doc_id, title, rel_path from documents where doc_id = 10",
    "sel_p7_exists": "with t as (select distinct lower(unnest(expected.must_contain)) term from holdout_b_gold) select term, exists (select 1 from chunks where contains(lower(content), term)) as found from t",
    "j7_full_outer": "select source, notes, questions from (select source, count(*) notes from documents where source is not null group by 1) full join (select source, count(*) questions from core_gold where source is not null group by 1) using (source)",
    "j11_semi_anti": "with b as (select distinct lower(trim(parent_id)) p from parent_blocks where parent_id is not null), c as (select distinct lower(trim(parent_id)) p from chunks where parent_id is not null) select count(*) filter (p in (select p from c)) as n, 'with' as side from b union all select count(*) filter (p not in (select p from c)), 'without' from b",
    "a1_counts": "select count(*) as n, count(distinct chunk_id) as ids, max(char_len) as longest from chunk_metadata",
    "w5_section_diversity": """with b as (select lower(trim(doc_id)) doc, parent_id, min(ord) ord, min(section_path) sp from parent_blocks where doc_id is not null and section_path <> '' group by 1, 2), t as (select *, row_number() over (partition by doc, sp order by ord, parent_id) turn from b)
 select * from (select doc, parent_id, row_number() over (partition by doc order by turn, ord, parent_id) as place from t) where place <= 5""",
    "w13_most_per_note": "with c as (select distinct lower(trim(doc_id)) doc, chunk_id from chunks where doc_id is not null and content like '%value%') select doc, chunk_id from (select *, row_number() over (partition by doc order by chunk_id) k from c) where k <= 2",
    "t2_stable_sort": "select chunk_id, max(char_len) as n from chunk_metadata where char_len is not null group by 1 order by n desc, chunk_id limit 100",
    "u2_candidates": "select lower(trim(doc_id)) as doc from trash union select lower(trim(doc_key)) from documents where status <> 'success'",
    "u4_minimal_cover": """with t as (select doc_id, regexp_extract_all(lower(title), '[a-z]{3,}') l from documents where title is not null), u as (select doc_id, list_filter(l, lambda v, i: list_position(l, v) = i) l from t)
 select doc_id, array_to_string(list_filter(l, lambda v: len(list_filter(l, lambda y: y <> v and contains(v, y))) = 0)[1:8], '|') as words from u""",
    "q5_content_terms": f"""with q as (select distinct id, query from core_gold), x as (select id, {SQ.tokens_sql("query")} kk, {SQ.terms_sql("query")} tt, {SQ.analyzed_sql("query")} aa from q)
 select id, array_to_string(tt, '|') as terms, array_to_string(list_filter(kk, lambda t: len({SQ.parts_sql("t")}) > 0), '|') as written, array_to_string(list_transform(list_filter(aa, lambda r: r.kind = 'S'), lambda r: r.run), '|') as scope,
 array_to_string(list_transform(list_filter(aa, lambda r: r.kind = 'T'), lambda r: r.run), '|') as target, array_to_string({SQ.marks_sql("tt", "kk")}, '|') as marks from x""",
    "q16_corpus_grams": f"""with t as (select distinct unnest({SQ.terms_sql("query")}) run from core_gold), r as (select run from t where regexp_full_match(run, '[{_CJK}]{{3,}}')), g as (select run, list_concat(list_transform(range(1, length(run) - 1), lambda i: substring(run, i, 3)), list_transform(range(1, length(run)), lambda i: substring(run, i, 2))) g from r),
 c as (select run, unnest(g) term, generate_subscripts(g, 1) o from g), w as (select distinct term from c where not regexp_matches(term, '[{Q.ASKING}]') and not list_contains({Q.STOPWORDS}, term)), f as (select term from w where exists (select 1 from chunks where contains(lower(content), lower(term)))),
 a as (select run, list(term order by o) a from (select run, term, min(o) o from c join f using (term) group by 1, 2) group by 1) select run, array_to_string(list_filter(a, lambda v: len(list_filter(a, lambda y: y <> v and contains(v, y))) = 0)[1:8], '|') as terms from a""",
    "q15_trimmed_terms": f"""with t as (select distinct unnest({SQ.tokens_sql("query")}) run from core_gold), r as (select run, length(run) n from t where regexp_full_match(run, '[{_CJK}]{{2,}}')), k as (select run, n, unnest(range(0, n - 1)) k from r),
 c as (select run, k o, left(run, n - k) term from k union all select run, n + k, right(run, n - k) from k where k >= 1), w as (select distinct term from c), f as (select term from w where exists (select 1 from chunks where contains(lower(content), lower(term)))) select run, arg_min(term, o) as term from c join f using (term) group by 1""",
    "v7_similarity_bands": """with k as (select q.vec_id q, e.vec_id v, list_distance(q.embedding::double[], e.embedding::double[]) d from embeddings q, embeddings e where q.vec_id % 20 = 0), r as (select d, row_number() over (partition by q order by round(d, 9), v) k from k), s as (select round(greatest(0, least(1, 1 - d * d / 2)), 4) s from r where k <= 5)
 select floor(s * 10)::bigint as band, count(*) as n, count(*) filter (s >= 0.6) as grounded from s group by 1""",
    "x23_evidence_phrases": """with p as (select parent_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '[*_`#>|\\[\\]()]', ' ', 'g'), '[\\n.,;:!?。，；：！？]'), lambda v: trim(v)), lambda v: length(v) >= 4)[1:6] p from parent_blocks where content is not null)
 select distinct parent_id, len(p) as n, array_to_string(p, '|') as phrases from p""",
    "l3_display_titles": "select doc_id, case when doc_id % 4 = 0 then coalesce('* ' || title, '') else coalesce(title, '') end as shown from documents",
    "r5_upserts": "select user_id, event_type, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value from events group by 1, 2",
}
