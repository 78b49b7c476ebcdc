"""Queries on captures, pages, collections, the trash and the stores that hold them."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import normalize_url
from quern.operators import library
from quern.operators.capture import capture, with_base
from quern.plans.scalar import URL_SQL
from quern.session import scratch_dir, table
from quern.sources import html
from quern.sources.scan import read_store


def _k(c: str):  # noqa: ANN202
    return F.lower(F.trim(F.col(c)))


def s26_capture_outcomes(s: SparkSession, d: str) -> DataFrame:
    """What becomes of the pages of the odd conversions if those of the even ones are in the index, by what is done with duplicates."""
    c = table(s, d, "conversion_results").where("kind = 'html' and source_url is not null").groupBy("conv_id").agg(F.max("ok").alias("ok"), F.max("markdown").alias("body"), F.max("source_url").alias("url"))
    index = c.where("ok and conv_id % 2 = 0").groupBy(normalize_url(F.col("url")).alias("normalized_url")).agg(F.min("conv_id").cast("string").alias("doc_id"))
    pages = c.where("conv_id % 2 = 1").select("conv_id", "ok", "body", "url")
    out = [capture(pages, index, how).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("on_duplicate"), "outcome", "n") for how in ("abort", "update", "new")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def x8_base_addresses(s: SparkSession, d: str) -> DataFrame:
    """Pages of three shapes with the address that their relative links start from."""
    p = table(s, d, "conversion_results").where("source_url is not null").select("conv_id", "source_url").distinct()
    shape = F.element_at(F.array(F.lit("<html><head><title>t</title></head><body>x</body></html>"), F.lit("<html lang='en'><body>x</body></html>"), F.lit("<p>x</p>"), F.lit("<head><base href='/'></head>")), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    return p.select("conv_id", F.md5(with_base(shape, F.col("source_url"))).alias("h")).distinct()


def x5_page_parts(s: SparkSession, d: str) -> DataFrame:
    """Titles and hosts as web pages, read back by the page parser: title, author, text and assets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                page = f'<html><head><title>x</title><meta property="og:title" content="{escape(t)}"><meta name="author" content="{escape(h)}"><style>no</style></head><body><p>{escape(t)}</p><script>no</script><img src="/a/{escape(h)}.png"></body></html>'
                data = page.encode("gb18030" if len(t) % 2 else "utf-8", "replace")
                text = data.decode(html.encoding_of(data, "gb18030" if len(t) % 2 else None))
                meta = html.metadata_of(text)
                out.append((meta.get("title", ""), meta.get("author", ""), html.text_of(text), ",".join(html.assets_of(text))))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4)]], ["doc_id", "title", "author", "text", "assets"])

    words = F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}]+", " "))
    t = table(s, d, "documents").where("host is not null").select("doc_id", words.alias("t"), "host").where("t <> ''")
    return t.mapInArrow(run, "doc_id long, title string, author string, text string, assets string")


def w6_section_paths(s: SparkSession, d: str) -> DataFrame:
    """The path of headings above each heading of every note, by running values: of each level the last one, unless a higher one came since."""
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("line like '#%'")
    h = lines.withColumn("level", F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))).where("level > 0").withColumn("t", F.trim(F.regexp_replace("line", "^#+ ", "")))
    w = W.partitionBy("doc_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    at = [F.max(F.when(F.col("level") == k, F.col("no"))).over(w).alias(f"n{k}") for k in range(1, 7)]
    named = [F.last(F.when(F.col("level") == k, F.col("t")), ignorenulls=True).over(w).alias(f"t{k}") for k in range(1, 7)]
    above = lambda k: F.greatest(*[F.coalesce(f"n{j}", F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
    parts = [F.when((F.col("level") >= k) & (F.col(f"n{k}") > above(k)), F.col(f"t{k}")) for k in range(1, 7)]
    return h.select("doc_id", "no", "level", *at, *named).select("doc_id", "no", F.array_join(F.array_compact(F.array(*parts)), " > ").alias("path"))


def l1_collections(s: SparkSession, d: str) -> DataFrame:
    """Folders as collections: one is created, one renamed, one deleted; with the notes that are left in each."""
    docs = table(s, d, "documents")
    folder = F.substring_index("rel_path", "/", 1)
    held = docs.select(folder.alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    held = library.create_collection(held, "new", "Later", "2024-02-01")
    first = docs.agg(F.min(folder).alias("id"))
    held = library.rename_collections(held, first.select("id", F.lit("First").alias("name")))
    gone = docs.agg(F.max(folder).alias("id"))
    members = docs.select("doc_id", F.explode(F.array(folder, F.lit("new"))).alias("id")).where("id <> 'new' or doc_id % 2 = 0")
    n = members.join(gone, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("notes"))
    return library.drop_collections(held, gone).join(n, "id", "left").select("name", F.coalesce("notes", F.lit(0)).alias("notes"))


def l3_trash_flow(s: SparkSession, d: str) -> DataFrame:
    """The trash after its log is replayed: the last entry of each note counts, restored notes are out again."""
    log = table(s, d, "trash").select(_k("doc_id").alias("doc"), "trashed_at", "restored_at").where("doc is not null")
    return library.in_trash(log, "doc").select("doc", "trashed_at")


def s33_store(s: SparkSession, d: str) -> DataFrame:
    """Memberships written as JSON and read back strictly."""
    docs = table(s, d, "documents").where("host is not null")
    path = f"{scratch_dir(s)}/store-{s.sparkContext.applicationId}"
    docs.select("doc_id", F.array("host").alias("collections")).write.mode("overwrite").json(path)
    got = read_store(s, path, "doc_id long, collections array<string>")
    return got.select(F.explode("collections").alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("notes"))


QUERIES = {f.__name__: f for f in [s26_capture_outcomes, x8_base_addresses, x5_page_parts, w6_section_paths, l1_collections, l3_trash_flow, s33_store]}
_SHAPES = ["<html><head><title>t</title></head><body>x</body></html>", "<html lang=''en''><body>x</body></html>", "<p>x</p>", "<head><base href=''/''></head>"]
_TAG = "'<base href=\"' || replace(replace(source_url, '&', '&amp;'), '\"', '&quot;') || '\">'"
_PARTS = ", ".join(f"case when level >= {k} and n{k} > greatest({', '.join([f'coalesce(n{j}, -1)' for j in range(1, k)] + ['-1'])}) then t{k} end" for k in range(1, 7))
SQL = {
    "s26_capture_outcomes": f"""with c as (select conv_id, max(ok) ok, max(markdown) body, max(source_url) source_url from conversion_results where kind = 'html' and source_url is not null group by 1), u as (select *, {URL_SQL} u from c), i as (select distinct u from u where ok and conv_id % 2 = 0),
 p as (select conv_id, ok, body, u, row_number() over (partition by u order by conv_id) k from u where conv_id % 2 = 1), h as (select unnest(['abort', 'update', 'new']) how),
 o as (select how, case when not ok then 'failed' when (u in (select u from i) or k > 1) and how = 'abort' then 'duplicate' when length(coalesce(body, '')) < 150 then 'partial_fallback' when (u in (select u from i) or k > 1) and how = 'update' then 'updated' else 'success' end as outcome from p, h)
 select how as on_duplicate, outcome, count(*) as n from o group by 1, 2""",
    "x8_base_addresses": f"""with p as (select distinct conv_id, source_url, {_TAG} t from conversion_results where source_url is not null) select distinct conv_id, md5(case conv_id % 4 when 0 then replace('{_SHAPES[0]}', '<head>', '<head>' || t) when 1 then replace('{_SHAPES[1]}', '<html lang=''en''>', '<html lang=''en''><head>' || t || '</head>')
 when 2 then t || '{_SHAPES[2]}' else '{_SHAPES[3]}' end) as h from p""",
    "x5_page_parts": "with t as (select doc_id, trim(regexp_replace(title, '[^\\p{L}\\p{N}]+', ' ', 'g')) t, host from documents where host is not null) select doc_id, t as title, host as author, t as text, '/a/' || host || '.png' as assets from t where t <> ''",
    "w6_section_paths": """with l as (select doc_id, string_split(text, chr(10)) l from documents where text is not null), x as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 no from l), g as (select doc_id, no, line, length(regexp_extract(line, '^(#{1,6}) ', 1)) level from x where starts_with(line, '#')),
 h as (select doc_id, no, level, trim(regexp_replace(line, '^#+ ', '')) t from g where level > 0), r as (select doc_id, no, level, """
    + ", ".join(f"max(case when level = {k} then no end) over w n{k}, last_value(case when level = {k} then t end ignore nulls) over w t{k}" for k in range(1, 7))
    + f" from h window w as (partition by doc_id order by no rows unbounded preceding)) select doc_id, no, array_to_string(list_filter([{_PARTS}], lambda v: v is not null), ' > ') as path from r",
    "l1_collections": """with f as (select doc_id, split_part(rel_path, '/', 1) id from documents), b as (select min(id) a, max(id) z from f), m as (select id from f union all select 'new' from f where doc_id % 2 = 0), n as (select id, count(*) n from m group by 1)
 select case when id = 'new' then 'Later' when id = (select a from b) then 'First' else id end as name, n as notes from n where id <> (select z from b)""",
    "l3_trash_flow": "with t as (select lower(trim(doc_id)) doc, arg_max(struct_pack(r := restored_at, t := trashed_at), struct_pack(a := coalesce(trashed_at, timestamp '1970-01-01'), b := coalesce(restored_at, timestamp '9999-01-01'))) x from trash where doc_id is not null group by 1) select doc, x.t as trashed_at from t where x.r is null",
    "s33_store": "select host as collection, count(*) as notes from documents where host is not null group by 1",
}
