"""Filters, joins, aggregates, windows, sorts and set operations over the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import CJK, detect_language, grams, normalize_url, query_terms
from quern.operators.lexical import match_terms
from quern.operators.retrieve import note_siblings, section_run
from quern.operators.skew import lookup, merged
from quern.plans.scalar import URL_SQL
from quern.session import table


def _k(c: str):  # noqa: ANN202
    return F.lower(F.trim(F.col(c)))


def s36_table_counts(s: SparkSession, d: str) -> DataFrame:
    names = ["documents", "parent_blocks", "chunk_metadata", "chunks", "trash", "conversion_results", "capture_results"]
    out = None
    for n in names:
        c = table(s, d, n).select(F.lit(n).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        out = c if out is None else out.unionByName(c)
    return out


def s34_restore_notes(s: SparkSession, d: str) -> DataFrame:
    """Notes rebuilt from their blocks in order; a block that was indexed again counts once."""
    b = table(s, d, "parent_blocks").where("content is not null and doc_id is not null").select(_k("doc_id").alias("doc"), "parent_id", "ord", "content").dropDuplicates(["doc", "parent_id"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "parent_id", "content"))), lambda x: x.content)
    return b.groupBy("doc").agg(F.md5(F.array_join(parts, "\n\n")).alias("h"), F.count(F.lit(1)).alias("blocks"))


def p1_defaults(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("host", F.lit("")).alias("host"))


def p3_substring(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where(F.lower("content").contains("register") | F.lower("content").contains("sensor")).groupBy(_k("doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("n"))


def p4_conjunction(s: SparkSession, d: str) -> DataFrame:
    words = ["the", "value", "filed"]
    cond = None
    for w in words:
        c = F.lower("content").contains(w)
        cond = c if cond is None else cond & c
    return table(s, d, "chunks").where(cond).select("chunk_id").distinct()


def p6_id_lookup(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "trash").select(_k("doc_id").alias("doc")).distinct()
    docs = table(s, d, "documents").select(_k("doc_key").alias("doc"), "doc_id", "title")
    return docs.join(wanted, "doc", "left_semi").select("doc_id", "title")


def p8_list_filter(s: SparkSession, d: str) -> DataFrame:
    """Notes that are not in the trash and whose title or path holds a word."""
    gone = table(s, d, "trash").where("restored_at is null").select(_k("doc_id").alias("doc")).distinct()
    docs = table(s, d, "documents").withColumn("doc", _k("doc_key"))
    hit = F.lower(F.coalesce("title", F.lit(""))).contains("report") | F.lower("rel_path").contains("report")
    return docs.join(gone, "doc", "left_anti").where(hit).select("doc_id")


def p9_orphan_rows(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(_k("doc_key").alias("doc")).distinct()
    return table(s, d, "chunks").where("doc_id is not null").withColumn("doc", _k("doc_id")).join(docs, "doc", "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def p10_chunk_prefix(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk_metadata")
    return c.groupBy(F.col("chunk_id").startswith(F.concat(_k("doc_id"), F.lit(":"))).alias("own")).agg(F.count(F.lit(1)).alias("n"))


def p11_section_prefix(s: SparkSession, d: str) -> DataFrame:
    top = F.split("section_path", " > ", 2)[0]
    b = table(s, d, "parent_blocks").where("section_path <> ''")
    return b.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("section_path").startswith(F.concat(top, F.lit(" > ")))).alias("below"))


def p12_min_length(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversion_results").where("kind = 'html'")
    state = F.when(F.coalesce(F.length("markdown"), F.lit(0)) < 150, "partial_fallback").otherwise("full")
    return c.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def j1_left_join(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", _k("doc_key").alias("doc"))
    meta = table(s, d, "chunk_metadata").where("doc_id is not null").groupBy(_k("doc_id").alias("doc")).agg(F.max("char_len").alias("longest"))
    return docs.join(meta, "doc", "left").select("doc_id", "longest")


def j2_newest_capture(s: SparkSession, d: str) -> DataFrame:
    """The newest capture of each page, whatever form its address was given in."""
    c = table(s, d, "conversion_results").where("source_url is not null").select("conv_id", normalize_url(F.col("source_url")).alias("url")).distinct()
    k = table(s, d, "capture_results").where("conv_id is not null and captured_at is not null")
    return k.join(c, "conv_id").groupBy("url").agg(F.max_by("capture_id", F.struct("captured_at", "capture_id")).alias("capture_id"))


def j3_evidence_lookup(s: SparkSession, d: str) -> DataFrame:
    """Every block with its note's number and path; the register's blocks meet its note by broadcast, all others by shuffle."""
    b = table(s, d, "parent_blocks").where("doc_id is not null").select("parent_id", _k("doc_id").alias("doc"), "source_start_line")
    used = b.groupBy("doc").agg(F.count(F.lit(1)).alias("_refs"))
    facts = merged(table(s, d, "documents").select(_k("doc_key").alias("doc"), F.col("doc_id").alias("note"), "rel_path"), used, "doc")
    return lookup(b, facts, "doc").where("note is not null").select("parent_id", F.col("note").alias("doc_id"), "rel_path", "source_start_line").distinct()


def j5_chunk_counts(s: SparkSession, d: str) -> DataFrame:
    """Chunks per note as the scalar subquery of the note list; the register's rows are counted before they are joined."""
    n = table(s, d, "chunk_metadata").where("doc_id is not null").groupBy(_k("doc_id").alias("doc")).agg(F.count_distinct("chunk_id").alias("n"))
    return table(s, d, "documents").withColumn("doc", _k("doc_key")).join(n, "doc", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"))


def j6_chunk_to_note(s: SparkSession, d: str) -> DataFrame:
    """Chunks with their block's section and their note's title; the hot note is joined by broadcast, all others by shuffle."""
    c = table(s, d, "chunks").where("doc_id is not null").select("chunk_id", _k("parent_id").alias("parent"), _k("doc_id").alias("doc"))
    blocks = table(s, d, "parent_blocks").groupBy(_k("parent_id").alias("parent")).agg(F.min("ord").alias("ord"))
    used = c.groupBy("doc").agg(F.count(F.lit(1)).alias("_refs"))
    facts = table(s, d, "documents").select(_k("doc_key").alias("doc"), "doc_id", "title").join(used, "doc")
    return lookup(c.join(blocks, "parent"), facts, "doc").where("doc_id is not null").select("chunk_id", "doc_id", "title", "ord").distinct()


def j12_vanished(s: SparkSession, d: str) -> DataFrame:
    """Notes of the trash that the index still has, and those it no longer has."""
    docs = table(s, d, "documents").select(_k("doc_key").alias("doc")).distinct()
    gone = table(s, d, "trash").select(_k("doc_id").alias("doc")).distinct()
    a = gone.join(docs, "doc", "left_semi").withColumn("state", F.lit("indexed"))
    return a.unionByName(gone.join(docs, "doc", "left_anti").withColumn("state", F.lit("vanished")))


def j13_originals(s: SparkSession, d: str) -> DataFrame:
    """Captured files and notes by the stem of their paths."""
    stem = lambda c: F.lower(F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", ""))
    files = table(s, d, "capture_results").where("file_path <> ''").select(stem("file_path").alias("stem")).distinct()
    notes = table(s, d, "documents").select(stem("rel_path").alias("stem")).distinct()
    a = files.join(notes, "stem", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("matched"))
    return a.unionByName(files.join(notes, "stem", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("orphan")))


def j14_membership(s: SparkSession, d: str) -> DataFrame:
    """Collections as the folders of notes: an array per note, exploded to a bridge."""
    parts = F.filter(F.slice(F.split("rel_path", "/"), 1, 2), lambda x: ~x.endswith(".md"))
    b = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(parts)).alias("collection"))
    return b.groupBy("collection").agg(F.count(F.lit(1)).alias("members"))


def a2_document_frequency(s: SparkSession, d: str) -> DataFrame:
    """Distinct chunks a term is in, and its weight; terms are the gold questions' required words."""
    terms = table(s, d, "core_gold").select(F.explode("expected.must_contain").alias("term")).select(F.lower("term").alias("term")).distinct()
    chunks = table(s, d, "chunks").select("chunk_id", "content")
    total = chunks.agg(F.count_distinct("chunk_id").alias("n_all"))
    df = match_terms(terms, chunks, "chunk_id", "content").groupBy("term").agg(F.count_distinct("chunk_id").alias("df"))
    x = terms.join(df, "term", "left").join(F.broadcast(total)).select("term", F.coalesce("df", F.lit(0)).alias("df"), "n_all")
    return x.select("term", "df", F.round(F.log((F.col("n_all") + 1) / (F.col("df") + 1)), 6).alias("idf"))


def a4_chunks_by_parent(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk_metadata").where("parent_id is not null")
    return c.groupBy(_k("parent_id").alias("parent")).agg(F.count_distinct("chunk_id").alias("n"), F.max("char_len").alias("longest"), F.min_by("chunk_id", F.struct("indexed_at", "chunk_id")).alias("first_chunk"))


def a5_term_frequency(s: SparkSession, d: str) -> DataFrame:
    """Chinese 2- to 4-grams, and ASCII words as written and in lower case, of all titles by how often they occur."""
    runs = F.regexp_extract_all("title", F.lit(f"[{CJK}]+"), 0)
    words = F.regexp_extract_all("title", F.lit(r"[A-Za-z][A-Za-z0-9_+#.\-]{2,}"), 0)
    cut = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3), grams(r, 4))))
    every = F.concat(cut, words, F.transform(words, F.lower))
    return table(s, d, "documents").where("title is not null").select(F.explode(every).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def a8_categories(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "core_gold").select("id", "category", "expected.answer_state").distinct()
    return g.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer_state") == "answered").alias("answered"))


def a9_confusion(s: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the detected language against the stated one."""
    x = table(s, d, "documents").where("lang is not null").select((detect_language(F.col("text")) == "zh").alias("p"), F.lower("lang").startswith("zh").alias("y"))
    tp, fp, fn = (F.count_if(c) for c in (F.col("p") & F.col("y"), F.col("p") & ~F.col("y"), ~F.col("p") & F.col("y")))
    return x.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def a12_folders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(F.substring_index("rel_path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


def a14_percentiles(s: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(s, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


def a15_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").agg(F.count_distinct("host").alias("hosts"), F.count_distinct(F.lower("sha1")).alias("hashes"), F.count_distinct("text").alias("texts"))


def a16_cube(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversion_results")
    return c.cube("kind", "ok").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).where("n > 1")


def w1_ranks(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("host").orderBy(F.desc("file_size"), "doc_id")
    return table(s, d, "documents").where("host is not null").select("doc_id", "host", F.row_number().over(w).alias("rank")).where("rank <= 3")


def _longest_block(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All blocks, and the longest of each note as the lead that others stand beside."""
    b = table(s, d, "parent_blocks").where("doc_id is not null and parent_id is not null").groupBy(_k("doc_id").alias("doc_id"), "parent_id").agg(F.min("ord").alias("ord"), F.min(F.coalesce("section_path", F.lit(""))).alias("section_path"), F.max(F.coalesce(F.length("content"), F.lit(0))).alias("n"))
    lead = b.groupBy("doc_id").agg(F.max_by(F.struct("parent_id", "section_path", "ord"), F.struct("n", "parent_id")).alias("l"))
    return b, lead.select(F.col("doc_id").alias("query_id"), "doc_id", F.col("l.parent_id").alias("lead"), F.col("l.section_path").alias("l_section"), F.col("l.ord").alias("l_ord"))


def w3_section_run(s: SparkSession, d: str) -> DataFrame:
    """Blocks behind the longest of each note that are still in its section, or in the nearest section above that goes on; at most 8."""
    b, lead = _longest_block(s, d)
    return section_run(merged(b, lead, "doc_id").where("ord > l_ord"), 8).select(F.col("doc_id").alias("doc"), "parent_id", "k")


def w4_siblings(s: SparkSession, d: str) -> DataFrame:
    """Blocks beside the longest of each note, those one level under its title if there are any; at most 12."""
    b, lead = _longest_block(s, d)
    return note_siblings(merged(b, lead, "doc_id").where("parent_id <> lead"), 12).select(F.col("doc_id").alias("doc"), "parent_id", "k")


def w8_line_numbers(s: SparkSession, d: str) -> DataFrame:
    """Lines of a note, by counting line feeds."""
    return table(s, d, "documents").where("text is not null").select("doc_id", (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


def w9_last_turns(s: SparkSession, d: str) -> DataFrame:
    """The last six events of each user, newest last."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").select("user_id", "event_id", "ts", F.row_number().over(w).alias("back")).where("back <= 6").select("user_id", "event_id", "back")


def w10_budget(s: SparkSession, d: str) -> DataFrame:
    """Blocks of a note taken in order while their characters fit a budget of 4000."""
    b = table(s, d, "parent_blocks").where("doc_id is not null and content is not null").groupBy(_k("doc_id").alias("doc"), "parent_id").agg(F.min("ord").alias("ord"), F.max(F.length("content")).alias("n"))
    w = W.partitionBy("doc").orderBy("ord", "parent_id").rowsBetween(W.unboundedPreceding, 0)
    return b.withColumn("used", F.sum("n").over(w)).where("used <= 4000").groupBy("doc").agg(F.count(F.lit(1)).alias("blocks"), F.max("used").alias("used"))


def w11_newest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("host is not null").groupBy("host").agg(F.max_by("doc_id", F.struct("mtime", "doc_id")).alias("doc_id"))


def w12_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Blocks that are, or stand next to, a block with a table."""
    b = table(s, d, "parent_blocks").where("doc_id is not null and content is not null").groupBy(_k("doc_id").alias("doc"), "parent_id").agg(F.min("ord").alias("ord"), F.max(F.when(F.col("content").contains("|---"), 1).otherwise(0)).alias("hit"))
    w = W.partitionBy("doc").orderBy("ord", "parent_id").rowsBetween(-1, 1)
    return b.withColumn("near", F.max("hit").over(w)).where("near = 1").select("doc", "parent_id", "hit")


def t6_note_list(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").orderBy(F.desc("mtime"), "doc_id").limit(200).select("doc_id", "mtime")


def t7_longest_terms(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "core_gold").select("id", "query").distinct()
    top = F.slice(F.array_sort(F.array_distinct(query_terms(F.col("query"))), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, 4)
    return q.select("id", F.array_join(top, "|").alias("terms"))


def t9_collated(s: SparkSession, d: str) -> DataFrame:
    """Sources without regard to letter case, in order."""
    x = table(s, d, "documents").where("source is not null").groupBy(F.collate(F.trim("source"), "UNICODE_CI").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min(F.lower(F.trim("source"))).alias("source"))
    return x.orderBy(F.desc("n"), "source").select("source", "n")


def u1_union_terms(s: SparkSession, d: str) -> DataFrame:
    """Words an answer must hold and must not hold, each once, in order."""
    g = table(s, d, "core_gold").select("id", F.array_distinct(F.concat("expected.must_contain", "expected.must_not_contain")).alias("u")).distinct()
    return g.select("id", F.array_join("u", "|").alias("words"), F.size("u").cast("long").alias("n"))


def u3_difference(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "core_gold").select(F.explode("expected.must_contain").alias("w"))
    b = table(s, d, "holdout_b_gold").select(F.explode("expected.must_contain").alias("w"))
    return a.subtract(b)


def u5_intersection(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "core_gold").select(F.explode("expected.must_contain").alias("w"))
    b = table(s, d, "holdout_b_gold").select(F.explode("expected.must_contain").alias("w"))
    return a.intersect(b)


def u6_trash_array(s: SparkSession, d: str) -> DataFrame:
    """The trash as sorted arrays per month: appended once, taken out on restore."""
    t = table(s, d, "trash").select(_k("doc_id").alias("doc"), F.date_format("trashed_at", "yyyy-MM").alias("month"), "restored_at")
    return t.groupBy("month").agg(F.array_join(F.array_sort(F.array_except(F.collect_set("doc"), F.collect_set(F.when(F.col("restored_at").isNotNull(), F.col("doc"))))), ",").alias("kept"))


def u7_except_all(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def j16_star_join(s: SparkSession, d: str) -> DataFrame:
    """Revenue by nation and year: filters reach the scans, small tables are broadcast by their size."""
    li = table(s, d, "lineitem").where("l_shipdate >= timestamp'1995-01-01'")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name", F.year("l_shipdate").alias("y")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_NAMES = "s36_table_counts s34_restore_notes p1_defaults p3_substring p4_conjunction p6_id_lookup p8_list_filter p9_orphan_rows p10_chunk_prefix p11_section_prefix p12_min_length j1_left_join j2_newest_capture j3_evidence_lookup j5_chunk_counts j6_chunk_to_note j12_vanished j13_originals j14_membership a2_document_frequency a4_chunks_by_parent a5_term_frequency a8_categories a9_confusion a12_folders a14_percentiles a15_distinct a16_cube w1_ranks w3_section_run w4_siblings w8_line_numbers w9_last_turns w10_budget w11_newest w12_neighbours t6_note_list t7_longest_terms t9_collated u1_union_terms u3_difference u5_intersection u6_trash_array u7_except_all j16_star_join"
#: Ids of projections and predicates get a prefix, as names in p and a number are those of the corpus problems.
QUERIES = {("sel_" + n if n[0] == "p" else n): globals()[n] for n in _NAMES.split()}

_DOC = "lower(trim(doc_id))"
_STEM = "lower(regexp_replace(regexp_extract({}, '[^/]*$', 0), '\\.[^.]*$', ''))"
_CJK = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}"
_LEAD = f"""with b as (select {_DOC} doc, parent_id, min(ord) ord, min(coalesce(section_path, '')) sp, max(coalesce(length(content), 0)) n from parent_blocks where doc_id is not null and parent_id is not null group by 1, 2),
 l as (select doc, arg_max(struct_pack(p := parent_id, s := sp, o := ord), struct_pack(n := n, p := parent_id)) l from b group by 1), x as (select b.*, l.l.p as lead, l.l.s as l_section, l.l.o as l_ord from b join l using (doc))"""

SQL = {
    "s36_table_counts": " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in ["documents", "parent_blocks", "chunk_metadata", "chunks", "trash", "conversion_results", "capture_results"]),
    "s34_restore_notes": f"""with b as (select distinct on (doc, parent_id) {_DOC} doc, parent_id, ord, content from parent_blocks where content is not null and doc_id is not null)
 select doc, md5(string_agg(content, chr(10) || chr(10) order by ord, parent_id, content)) as h, count(*) as blocks from b group by 1""",
    "sel_p1_defaults": "select doc_id, coalesce(title, '') as title, coalesce(status, '') as status, coalesce(host, '') as host from documents",
    "sel_p3_substring": f"select {_DOC} as doc, count(*) as n from chunks where contains(lower(content), 'register') or contains(lower(content), 'sensor') group by 1",
    "sel_p4_conjunction": "select distinct chunk_id from chunks where contains(lower(content), 'the') and contains(lower(content), 'value') and contains(lower(content), 'filed')",
    "sel_p6_id_lookup": f"select doc_id, title from documents where lower(trim(doc_key)) in (select {_DOC} from trash)",
    "sel_p8_list_filter": f"select doc_id from documents where lower(trim(doc_key)) not in (select {_DOC} from trash where restored_at is null and doc_id is not null) and (contains(lower(coalesce(title, '')), 'report') or contains(lower(rel_path), 'report'))",
    "sel_p9_orphan_rows": f"select {_DOC} as doc, count(*) as n from chunks where doc_id is not null and {_DOC} not in (select lower(trim(doc_key)) from documents) group by 1",
    "sel_p10_chunk_prefix": f"select starts_with(chunk_id, {_DOC} || ':') as own, count(*) as n from chunk_metadata group by 1",
    "sel_p11_section_prefix": "select split_part(section_path, ' > ', 1) as top, count(*) as n, count(*) filter (starts_with(section_path, split_part(section_path, ' > ', 1) || ' > ')) as below from parent_blocks where section_path <> '' group by 1",
    "sel_p12_min_length": "select case when coalesce(length(markdown), 0) < 150 then 'partial_fallback' else 'full' end as state, count(*) as n from conversion_results where kind = 'html' group by 1",
    "j1_left_join": f"select d.doc_id, m.longest from documents d left join (select {_DOC} doc, max(char_len) longest from chunk_metadata where doc_id is not null group by 1) m on lower(trim(d.doc_key)) = m.doc",
    "j2_newest_capture": f"select url, max_by(capture_id, (captured_at, capture_id)) as capture_id from capture_results join (select distinct conv_id, {URL_SQL} as url from conversion_results where source_url is not null) using (conv_id) where captured_at is not null group by 1",
    "j3_evidence_lookup": "with b as (select distinct parent_id, lower(trim(doc_id)) doc, source_start_line from parent_blocks) select distinct parent_id, d.doc_id, rel_path, source_start_line from b join documents d on b.doc = lower(trim(d.doc_key))",
    "j5_chunk_counts": f"select d.doc_id, (select count(distinct chunk_id) from chunk_metadata c where {_DOC.replace('doc_id', 'c.doc_id')} = lower(trim(d.doc_key))) as chunks from documents d",
    "j6_chunk_to_note": """with c as (select distinct chunk_id, lower(trim(parent_id)) p, lower(trim(doc_id)) k from chunks where doc_id is not null), b as (select lower(trim(parent_id)) p, min(ord) o from parent_blocks group by 1)
 select distinct chunk_id, d.doc_id, d.title, b.o as ord from c join b using (p) join documents d on c.k = lower(trim(d.doc_key))""",
    "j12_vanished": f"with g as (select distinct {_DOC} doc from trash) select doc, case when doc in (select lower(trim(doc_key)) from documents) then 'indexed' else 'vanished' end as state from g",
    "j13_originals": f"with f as (select distinct {_STEM.format('file_path')} s from capture_results where file_path <> ''), n as (select distinct {_STEM.format('rel_path')} s from documents) select count(*) filter (s in (select s from n)) as n, 'matched' as state from f union all select count(*) filter (s not in (select s from n)), 'orphan' from f",
    "j14_membership": "with b as (select doc_id, unnest(list_distinct(list_filter(string_split(rel_path, '/')[1:2], lambda v: not ends_with(v, '.md')))) c from documents) select c as collection, count(*) as members from b group by 1",
    "a2_document_frequency": """with t as (select distinct lower(unnest(expected.must_contain)) term from core_gold), n as (select count(distinct chunk_id) n from chunks), f as (select term, count(distinct chunk_id) df from t join chunks on contains(lower(content), term) group by 1)
 select term, coalesce(df, 0) as df, round(ln((n + 1) / (coalesce(df, 0) + 1)), 6) as idf from t left join f using (term), n""",
    "a4_chunks_by_parent": "select lower(trim(parent_id)) as parent, count(distinct chunk_id) as n, max(char_len) as longest, arg_min(chunk_id, (coalesce(indexed_at, timestamp '1000-01-01'), chunk_id)) as first_chunk from chunk_metadata where parent_id is not null group by 1",
    "a5_term_frequency": f"""with t as (select title from documents where title is not null), r as (select unnest(regexp_extract_all(title, '[{_CJK}]+')) r from t), k as (select r, unnest([2, 3, 4]) k from r),
 g as (select unnest(list_transform(range(1, length(r) - k + 2), lambda i: substring(r, i, k))) w from k where length(r) >= k), a as (select unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9_+#.\\-]{{2,}}')) w from t)
 select w, count(*) as n from (select w from g union all select w from a union all select lower(w) from a) group by 1 having count(*) >= 2""",
    "a8_categories": "with g as (select distinct id, category, expected.answer_state a from core_gold) select category, count(*) as n, count(*) filter (a = 'answered') as answered from g group by rollup (category)",
    "a9_confusion": """with c as (select lower(lang) lang, coalesce(text, '') t, len(regexp_extract_all(coalesce(text, ''), '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]')) k, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_+#.\\-]{2,}')) w from documents where lang is not null),
 x as (select starts_with(lang, 'zh') y, trim(regexp_replace(t, '\\s', ' ', 'g')) <> '' and (k >= 20 and k >= w * 2 or not (w >= 10 and k < w) and not (k > 0 and w > 0) and k > 0) p from c), n as (select count(*) filter (p and y) tp, count(*) filter (p and not y) fp, count(*) filter (not p and y) fn from x)
 select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall from n""",
    "a12_folders": "select split_part(rel_path, '/', 1) as folder, count(*) as n, sum(file_size)::bigint as bytes from documents group by 1",
    "a14_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "a15_distinct": "select count(distinct host) as hosts, count(distinct lower(sha1)) as hashes, count(distinct text) as texts from documents",
    "a16_cube": "select kind, ok, count(*) as n, grouping(kind, ok) as level from conversion_results group by cube (kind, ok) having count(*) > 1",
    "w1_ranks": "select * from (select doc_id, host, row_number() over (partition by host order by file_size desc, doc_id) as rank from documents where host is not null) where rank <= 3",
    "w3_section_run": _LEAD + """, a as (select x.*, unnest(range(1, len(string_split(l_section, ' > ')) + 1)) level from x where ord > l_ord and l_section <> ''), p as (select *, array_to_string(string_split(l_section, ' > ')[1:level], ' > ') prefix from a),
 i as (select *, sp = prefix or starts_with(sp, prefix || ' > ') inside from p), o as (select *, bool_or(not inside and sp <> '') over (partition by doc, level order by ord, parent_id rows unbounded preceding) over_ from i),
 k as (select *, row_number() over (partition by doc, level order by ord, parent_id) k from o where inside and not over_), m as (select *, max(level) over (partition by doc) deepest from k where k <= 8) select doc, parent_id, k from m where level = deepest""",
    "w4_siblings": _LEAD + """, y as (select *, len(string_split(sp, ' > ')) = 2 sec from x where parent_id <> lead), z as (select *, bool_or(sec) over (partition by doc) any_ from y)
 select doc, parent_id, k from (select doc, parent_id, row_number() over (partition by doc order by ord, parent_id) as k from z where sec or not any_) where k <= 12""",
    "w8_line_numbers": "select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines from documents where text is not null",
    "w9_last_turns": "select user_id, event_id, back from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events) where back <= 6",
    "w10_budget": f"""with b as (select {_DOC} doc, parent_id, min(ord) ord, max(length(content)) n from parent_blocks where doc_id is not null and content is not null group by 1, 2), u as (select doc, sum(n) over (partition by doc order by ord, parent_id rows unbounded preceding) u from b)
 select doc, count(*) as blocks, max(u)::bigint as used from u where u <= 4000 group by 1""",
    "w11_newest": "select host, max_by(doc_id, (mtime, doc_id)) as doc_id from documents where host is not null group by 1",
    "w12_neighbours": f"""with b as (select {_DOC} doc, parent_id, min(ord) ord, max(contains(content, '|---')::int) hit from parent_blocks where doc_id is not null and content is not null group by 1, 2)
 select doc, parent_id, hit from (select *, max(hit) over (partition by doc order by ord, parent_id rows between 1 preceding and 1 following) near from b) where near = 1""",
    "t6_note_list": "select doc_id, mtime from documents order by mtime desc, doc_id limit 200",
    "t7_longest_terms": "with q as (select distinct id, query from core_gold), t as (select distinct id, unnest(regexp_extract_all(query, '[A-Za-z0-9_+#.]+|[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]+')) t from q), r as (select *, row_number() over (partition by id order by length(t) desc, t) k from t) select id, string_agg(t, '|' order by k) as terms from r where k <= 4 group by 1",
    "t9_collated": "select lower(trim(source)) as source, count(*) as n from documents where source is not null group by 1",
    "u1_union_terms": "with u as (select distinct id, list_concat(expected.must_contain, expected.must_not_contain) l from core_gold), f as (select id, list_filter(l, lambda v, i: list_position(l, v) = i) l from u) select distinct id, array_to_string(l, '|') as words, len(l) as n from f",
    "u3_difference": "select unnest(expected.must_contain) as w from core_gold except select unnest(expected.must_contain) from holdout_b_gold",
    "u5_intersection": "select unnest(expected.must_contain) as w from core_gold intersect select unnest(expected.must_contain) from holdout_b_gold",
    "u6_trash_array": f"with t as (select strftime(trashed_at, '%Y-%m') m, {_DOC} k, bool_or(restored_at is not null) r from trash group by 1, 2) select m as month, coalesce(string_agg(k, ',' order by k) filter (not r), '') as kept from t group by 1",
    "u7_except_all": "select k, count(*) as n from (select c_nationkey k from customer except all select s_nationkey from supplier) group by 1",
    "j16_star_join": "select n_name, year(l_shipdate) as y, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_shipdate >= timestamp '1995-01-01' group by all",
}
SQL = {k: v for k, v in SQL.items() if v}
