"""The index of notes: six tables made from the notes' texts, imports and manual notes, versions and vector spaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import detect_language, display_source, entities, frontmatter, host_of, markdown_title, normalize_url, strip_frontmatter
from quern.operators import vector
from quern.operators.chunking import children, parse_notes
from quern.operators.library import with_keywords
from quern.operators.skew import merged
from quern.session import table, write_once
from quern.sources.convert import convert_files
from quern.sources.scan import documents_of, replace_notes

# Most characters of keywords, language, summary, entities (as JSON) and source in the index; kinds of entities; version.
KEYWORD_CHARS, LANGUAGE_CHARS, SUMMARY_CHARS, ENTITY_CHARS, SOURCE_CHARS = 600, 16, 300, 900, 300
KINDS = ["date", "money", "percent", "url", "email", "organisation"]
VERSION = "1.7"


def frontmatter_of(fields: list[tuple[str, Column]]) -> Column:
    """A front matter block of the fields that have a value, quoted, each on one line."""
    line = lambda k, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'{k}: "'), F.trim(F.replace(F.replace(v, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))), F.lit('"')))
    return F.array_join(F.array_compact(F.array(F.lit("---"), *[line(k, v) for k, v in fields], F.lit("---"))), "\n")


def imported(files: DataFrame) -> DataFrame:
    """Notes (``rel_path, text, file_size, mtime``) of files (``path, content, length, modificationTime``) that could be converted."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    done = merged(convert_files(files).where("ok"), files.select("path", "length", "modificationTime"), "path")
    head = frontmatter_of([("title", F.col("title")), ("source_file", F.substring_index("path", "/", -1)), ("source_type", F.col("kind"))])
    return done.select(F.concat(F.lit("imports/"), stem, F.lit(".md")).alias("rel_path"), F.concat(head, F.lit("\n\n"), "markdown").alias("text"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))


def manual_notes(drafts: DataFrame) -> DataFrame:
    """Notes of drafts (``title, body, written_at``); blank bodies make none, blank titles are taken from the time."""
    stamp = F.date_format("written_at", "yyyyMMdd_HHmmss")
    title = F.coalesce(F.when(F.trim("title") != "", F.trim("title")), stamp)
    name = F.concat(F.lit("notes/"), stamp, F.lit("_"), F.substring(F.regexp_replace(title, r"[^\w\x{4e00}-\x{9fff}]+", "-"), 1, 40), F.lit(".md"))
    text = F.concat(frontmatter_of([("title", title), ("source_type", F.lit("manual"))]), F.lit("\n\n# "), title, F.lit("\n\n"), "body")
    return drafts.where(F.trim("body") != "").select(name.alias("rel_path"), text.alias("text"), F.octet_length(text).cast("long").alias("file_size"), F.col("written_at").alias("mtime"))


def build_index(notes: DataFrame, dim: int = 512) -> dict[str, DataFrame]:
    """The six tables of notes (``rel_path, text, file_size, mtime``): documents, parent_blocks, chunks, chunk_metadata, chunks_vec, doc_meta.

    Null texts give a document without blocks. Texts are parsed once; nothing but the
    parents is written on the way.
    """
    docs = documents_of(notes).drop("display_source")
    parents = write_once(parse_notes(notes), "parents")
    kids = children(parents)
    meta = frontmatter(F.col("text"))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    found = F.to_json(F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[entities(F.col("text"), k) for k in KINDS])), lambda k, v: F.size(v) > 0))
    body = F.trim(F.regexp_replace(strip_frontmatter(F.coalesce("text", F.lit(""))), r"\s+", " "))
    facts = notes.join(docs.select("rel_path", "doc_id", "title"), "rel_path")
    words = with_keywords(facts.select("doc_id", "title", "text"))
    source = display_source(meta["source_file"], F.col("title"), F.col("rel_path"))
    doc_meta = facts.select(
        "doc_id", cut(host_of(meta["source_url"]), SOURCE_CHARS).alias("host"), cut(detect_language(F.col("text")), LANGUAGE_CHARS).alias("language"), cut(F.coalesce(meta["summary"], body), SUMMARY_CHARS).alias("summary"), cut(found, ENTITY_CHARS).alias("entities"), normalize_url(meta["source_url"]).alias("normalized_url"), cut(source, SOURCE_CHARS).alias("display_source"),
    ).join(words.select("doc_id", cut(F.array_join("keywords", " "), KEYWORD_CHARS).alias("keywords")), "doc_id")
    return {
        "documents": docs,
        "parent_blocks": parents.drop("children", "first_child"),
        "chunks": kids,
        "chunk_metadata": kids.select("chunk_id", "doc_id", "parent_id", F.length("content").alias("char_len")),
        "chunks_vec": vector.embed(kids.select("chunk_id", "retrieval_text"), "retrieval_text", dim).select("chunk_id", "embedding"),
        "doc_meta": doc_meta,
    }


def update_index(index: dict[str, DataFrame], fresh: dict[str, DataFrame], gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table with the rows of the fresh notes in place of their old ones; tables keyed by chunk follow their note's chunks."""
    notes = fresh["documents"].select("doc_id").distinct()
    notes = notes if gone is None else notes.unionByName(gone.select("doc_id")).distinct()
    old = index["chunks"].join(notes, "doc_id", "left_semi").select("chunk_id")
    out = {n: replace_notes(df, fresh[n], notes) for n, df in index.items() if "doc_id" in df.columns}
    return out | {n: df.join(old, "chunk_id", "left_anti").unionByName(fresh[n]) for n, df in index.items() if "doc_id" not in df.columns}


def version_state(found: str | None, exists: bool = True, wanted: str = VERSION) -> str:
    """What to do with an index of a version: fresh, ok, upgrade and unknown (built anew), or downgrade (refused)."""
    if not exists:
        return "fresh"
    try:
        have, want = (tuple(map(int, v.split("."))) for v in (found or "", wanted))
    except ValueError:
        return "unknown"
    return "ok" if have == want else "upgrade" if have < want else "downgrade"


@dataclass(frozen=True)
class VectorSpace:
    """What vectors were made with; only vectors of one space can be compared."""

    source: str = ""
    model: str = ""
    dim: int = 0
    artifact: str = ""
    tokenizer: str = ""
    precision: str = ""

    def problem(self, stored: VectorSpace | None) -> str | None:
        """Why stored vectors can't be searched with this space, or None; bytes that an older record lacks are not compared."""
        if stored is None:
            return None
        if stored.dim != self.dim:
            return "dimension"
        if (stored.source, stored.model) != (self.source, self.model):
            return "model"
        parts = [(stored.artifact, self.artifact), (stored.tokenizer, self.tokenizer), (stored.precision, self.precision)]
        return "artifact" if any(a and b and a != b for a, b in parts) else None


def merge_manifest(stored: dict[str, str] | None, current: dict[str, str], readable: int) -> dict[str, str]:
    """A library's manifest with what is current; keys that are not known stay, and a data version above ``readable`` is refused."""
    held = dict(stored or {})
    if int(held.get("data_version") or 0) > readable:
        raise ValueError(f"data version {held['data_version']} is newer than {readable}")
    return {**current, **held, "data_version": str(readable)}


def choose_embedder(wanted: str, available: list[str]) -> str | None:
    """The embedder to use: the one wanted if it is there, else the first that is, but hashing only when it is asked for."""
    order = ["local_onnx", "ollama", "api"]
    if wanted in available:
        return wanted
    return next((e for e in order if e in available), None)


def register_functions(spark: SparkSession) -> None:
    """Make parsing, embedding and keywords callable from SQL: ``parse_note`` and ``evidence_units`` as table functions, ``hash_embedding`` and ``note_keywords``."""
    from pyspark.sql.functions import udtf

    from quern.functions import keywords as K
    from quern.functions import markdown as M

    @udtf(returnType="ord int, section_path string, first_line int, last_line int, content string, children array<string>")
    class ParseNote:
        def eval(self, text: str):  # noqa: ANN202
            for i, p in enumerate(M.parse_note(text or "")):
                yield i, p.section_path, p.first_line, p.last_line, p.content, p.children

    @udtf(returnType="text string, kind string, line int")
    class EvidenceUnits:
        def eval(self, content: str):  # noqa: ANN202
            yield from M.evidence_units(content or "")

    spark.udtf.register("parse_note", ParseNote)
    spark.udtf.register("evidence_units", EvidenceUnits)
    spark.udf.register("hash_embedding", lambda t: vector.hash_embedding(t).tolist(), "array<float>")
    spark.udf.register("note_keywords", lambda t: [w for w, _ in K.keywords(t)], "array<string>")


def match_claims(claims: DataFrame, blocks: DataFrame, key: str = "claim_id") -> DataFrame:
    """The sentence of its block that best supports each claim: ``claim_id, start, end, mode, score``; none below 0.34.

    ``claims``: ``claim_id, parent_id, claim``; ``blocks``: ``parent_id, content``.
    Claims shorter than four characters have none. A sentence that holds the claim,
    or is held by it, scores above one; any other the share of the claim's numbers,
    words and pairs of Chinese characters that it has. Of equals the first counts.
    """
    met = merged(claims.select(key, "parent_id", claim_form(F.col("claim")).alias("c")).where(F.length("c") >= 4), blocks.select("parent_id", "content"), "parent_id")
    ends = "[。！？；\n\r]"
    parts = F.split("content", ends)
    before = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.element_at(parts, i).alias("raw"), (F.aggregate(F.slice(parts, 1, i - 1), F.lit(0), lambda a, x: a + F.length(x) + 1)).alias("at")))
    each = met.select(key, "c", F.explode(before).alias("x")).where(F.trim(F.regexp_replace("x.raw", r"\s+", " ")) != "")
    lead = F.length("x.raw") - F.length(F.regexp_replace("x.raw", r"^\s+", ""))
    tail = F.length("x.raw") - F.length(F.regexp_replace("x.raw", r"\s+$", ""))
    s = each.select(key, "c", claim_form(F.col("x.raw")).alias("s"), (F.col("x.at") + lead).alias("start"), (F.col("x.at") + F.length("x.raw") - tail).alias("end")).where("s <> ''")
    whole = F.col("s").contains(F.col("c")) | F.col("c").contains(F.col("s"))
    toks = claim_tokens(F.col("c"))
    share = F.try_divide(F.size(F.filter(toks, lambda t: F.col("s").contains(t))).cast("double"), F.size(toks))
    ratio = F.least(F.length("s"), F.length("c")) / F.greatest(F.length("s"), F.length("c"))
    scored = s.select(key, "start", "end", F.when(whole, "exact").otherwise("overlap").alias("mode"), F.round(F.when(whole, 1 + ratio).otherwise(share), 6).alias("score")).where("score > 0")
    best = scored.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "start"))).where("k = 1 and (mode = 'exact' or score >= 0.34)")
    return best.select(key, "start", "end", "mode", "score")


# Marks before a claim, and marks at its ends.
CLAIM_LEAD = r"^\s*(?:[•·▪◦‣]|[-*–—]|\d{1,3}\s*[.)、．]|[（(]\s*\d{1,3}\s*[）)])\s*"
CLAIM_ENDS = "，。！？；：、,.!?;:…\"'“”‘’"


def claim_form(c: Column) -> Column:
    """A claim as it is compared: without list marks, white space, letter case and marks at the ends."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), CLAIM_LEAD, ""), r"[\s\x{3000}]+", ""))
    return F.regexp_replace(bare, f"^[{CLAIM_ENDS}]+|[{CLAIM_ENDS}]+$", "")


def claim_tokens(c: Column) -> Column:
    """Numbers, words and pairs of Chinese characters, each once."""
    runs = F.regexp_extract_all(c, F.lit(r"[\x{3400}-\x{9fff}]+"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(r"\d+"), 0), F.regexp_extract_all(c, F.lit("[a-z]+"), 0), pairs))


def _notes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("rel_path", "text", "file_size", F.timestamp_seconds("mtime").alias("mtime"))


def s2_index_tables(s: SparkSession, d: str) -> DataFrame:
    """Rows and distinct notes of the six tables made of all notes."""
    index = build_index(_notes(s, d))
    ids = {n: "doc_id" if "doc_id" in df.columns else "chunk_id" for n, df in index.items()}
    out = [df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring(ids[n], 1, 16)).alias("notes")).select(F.lit(n).alias("name"), "n", "notes") for n, df in index.items()]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def s29_index_rewrite(s: SparkSession, d: str) -> DataFrame:
    """Documents of an index in which every third note is replaced by its next version and every seventh is gone."""
    notes = _notes(s, d).where("text is not null").withColumn("k", F.pmod(F.length("text"), F.lit(21)))
    index = {n: write_once(df, n) for n, df in build_index(notes.drop("k")).items()}
    fresh = build_index(notes.where("k % 3 = 0 and k % 7 <> 0").drop("k").withColumn("text", F.concat("text", F.lit("\n\nrevised"))))
    gone = notes.where("k % 7 = 0").select(F.substring(F.sha1(F.col("rel_path").cast("binary")), 1, 16).alias("doc_id"))
    return update_index(index, fresh, gone)["documents"].select("doc_id", "rel_path", "file_size", "prefix_hash")


def s27_imports(s: SparkSession, d: str) -> DataFrame:
    """Notes that the converted pages become when they are imported as text files."""
    c = table(s, d, "conversion_results").where("ok and markdown <> ''").groupBy("conv_id").agg(F.max("markdown").alias("markdown"))
    files = c.select(F.concat(F.lit("in/c"), "conv_id", F.lit(".txt")).alias("path"), F.encode("markdown", "utf-8").alias("content"), F.octet_length("markdown").cast("long").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))
    n = imported(files)
    return n.select("rel_path", F.element_at(F.split("text", "\n"), 3).alias("source_line"), F.length("text").alias("n_chars"))


def s28_manual_notes(s: SparkSession, d: str) -> DataFrame:
    """Titles and blocks as drafts of manual notes."""
    b = table(s, d, "parent_blocks").where("parent_id is not null").groupBy("parent_id").agg(F.min("section_path").alias("title"), F.min("content").alias("body"))
    drafts = b.select(F.trim(F.substring_index("title", ">", -1)).alias("title"), "body", F.lit("2024-05-06 07:08:09").cast("timestamp").alias("written_at"))
    return manual_notes(drafts.where("body is not null")).groupBy(F.substring("rel_path", 1, 21).alias("begins")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def x21_frontmatter(s: SparkSession, d: str) -> DataFrame:
    head = frontmatter_of([("title", F.col("title")), ("host", F.col("host")), ("status", F.col("status"))])
    return table(s, d, "documents").select("doc_id", F.md5(head).alias("h"))


def x22_claims(s: SparkSession, d: str) -> DataFrame:
    """For each chunk its own end as a claim, with the sentence of its block that supports it."""
    c = table(s, d, "chunks").where("content is not null and parent_id is not null").select("chunk_id", F.lower(F.trim("parent_id")).alias("parent_id"), F.right("content", F.lit(40)).alias("claim")).distinct()
    b = table(s, d, "parent_blocks").where("content is not null and parent_id is not null").groupBy(F.lower(F.trim("parent_id")).alias("parent_id")).agg(F.max("content").alias("content"))
    return match_claims(c, b, "chunk_id")


def x13_analysis(s: SparkSession, d: str) -> DataFrame:
    """Language, length and kinds of entities of every note, as on import."""
    t = F.col("text")
    some = F.array_join(F.filter(F.array(*[F.when(F.size(entities(t, k)) > 0, F.lit(k)) for k in ("percent", "email")]), lambda x: x.isNotNull()), ",")
    return table(s, d, "documents").where("text is not null").select("doc_id", detect_language(t).alias("language"), F.length(strip_frontmatter(t)).alias("chars"), some.alias("kinds"))


def f6_sql_functions(s: SparkSession, d: str) -> DataFrame:
    """Blocks of notes by the table function, called from SQL."""
    register_functions(s)
    table(s, d, "documents").where("text is not null").select("doc_id", "text").createOrReplaceTempView("quern_notes")
    return s.sql("select doc_id, count(*) as blocks, sum(size(p.children)) as children from quern_notes, lateral parse_note(text) p group by doc_id")


QUERIES = {f.__name__: f for f in [s2_index_tables, s27_imports, s28_manual_notes, s29_index_rewrite, x13_analysis, x21_frontmatter, x22_claims, f6_sql_functions]}
_LINE = "case when coalesce({v}, '') <> '' then '{k}: \"' || trim(replace(replace({v}, '\"', ''''), chr(10), ' ')) || '\"' end"
_FORM = lambda c: f"regexp_replace(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '{CLAIM_LEAD}', ''), '[\\s\\x{{3000}}]+', '', 'g')), '^[{CLAIM_ENDS.replace(chr(39), chr(39) * 2)}]+|[{CLAIM_ENDS.replace(chr(39), chr(39) * 2)}]+$', '', 'g')"
SQL = {
    "s29_index_rewrite": """with n as (select *, length(text) % 21 k from documents where text is not null) select substring(sha1(rel_path), 1, 16) as doc_id, rel_path, file_size,
 sha1(encode(case when k % 3 = 0 then text || chr(10) || chr(10) || 'revised' else text end)[1:4096]) as prefix_hash from n where k % 7 <> 0""",
    "s27_imports": """select 'imports/c' || conv_id || '.md' as rel_path, 'source_file: "c' || conv_id || '.txt"' as source_line, length(concat_ws(chr(10), '---', 'title: "c' || conv_id || '"', 'source_file: "c' || conv_id || '.txt"', 'source_type: "text"', '---', '', max(markdown))) as n_chars from conversion_results where ok and markdown <> '' group by conv_id""",
    "s28_manual_notes": """with b as (select parent_id, trim(regexp_extract(min(section_path), '[^>]*$', 0)) t, min(content) c from parent_blocks where parent_id is not null group by 1), n as (select coalesce(nullif(t, ''), '20240506_070809') t, c from b where trim(c) <> '')
 select 'notes/20240506_070809' as begins, count(*) as n, sum(length(concat_ws(chr(10), '---', 'title: "' || trim(replace(t, '"', '''')) || '"', 'source_type: "manual"', '---', '', '# ' || t, '', c))) as chars from n""",
    "x21_frontmatter": "select doc_id, md5(array_to_string(list_filter(['---', " + ", ".join(_LINE.format(k=k, v=k) for k in ("title", "host", "status")) + ", '---'], lambda v: v is not null), chr(10))) as h from documents",
    "x22_claims": f"""with c as (select distinct chunk_id, lower(trim(parent_id)) p, {_FORM("right(content, 40)")} c from chunks where content is not null and parent_id is not null), b as (select lower(trim(parent_id)) p, max(content) content from parent_blocks where content is not null and parent_id is not null group by 1),
 m as (select chunk_id, c, regexp_split_to_array(content, '[。！？；\\n\\r]') r from c join b using (p) where length(c) >= 4), e as (select chunk_id, c, unnest(r) raw, generate_subscripts(r, 1) i, r from m), x as (select chunk_id, c, raw, list_sum(list_concat([0], list_transform(r[1:i - 1], lambda v: length(v) + 1)))::int at_ from e),
 s as (select chunk_id, c, {_FORM("raw")} s, at_ + length(raw) - length(regexp_replace(raw, '^\\s+', '')) as start_, at_ + length(regexp_replace(raw, '\\s+$', '')) as end_ from x where trim(regexp_replace(raw, '\\s+', ' ', 'g')) <> ''),
 t as (select *, contains(s, c) or contains(c, s) w, list_distinct(list_concat(regexp_extract_all(c, '[0-9]+'), regexp_extract_all(c, '[a-z]+'), flatten(list_transform(regexp_extract_all(c, '[\\x{{3400}}-\\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))) k from s where s <> ''),
 z as (select chunk_id, start_, end_, case when w then 'exact' else 'overlap' end as mode, round(case when w then 1 + least(length(s), length(c))::double / greatest(length(s), length(c)) else len(list_filter(k, lambda v: contains(s, v)))::double / nullif(len(k), 0) end, 6) as score from t),
 q as (select *, row_number() over (partition by chunk_id order by score desc, start_) n from z where score > 0) select chunk_id, start_ as start, end_ as end, mode, score from q where n = 1 and (mode = 'exact' or score >= 0.34)""",
}
