"""Queries over single rows: text, addresses, front matter, question analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.session import table

_D = "documents"


def x1_normalized_urls(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversion_results").where("source_url is not null")
    return c.select("conv_id", X.normalize_url(F.col("source_url")).alias("url")).distinct()


def x2_tracking_params(s: SparkSession, d: str) -> DataFrame:
    q = F.explode(F.split(F.regexp_extract("source_url", r"\?([^#]*)", 1), "&")).alias("param")
    p = table(s, d, "conversion_results").where("source_url is not null").select(q).where("param <> ''").select(F.substring_index("param", "=", 1).alias("name"))
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("tracking", X.is_tracking(F.col("name")))


def x3_hosts(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversion_results").where("source_url is not null")
    return c.groupBy(X.host_of(F.col("source_url")).alias("host")).agg(F.count_distinct("conv_id").alias("pages"))


def j4_url_duplicates(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversion_results").where("source_url is not null and ok").select("conv_id", X.normalize_url(F.col("source_url")).alias("url"))
    return c.groupBy("url").agg(F.count_distinct("conv_id").alias("n"), F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv")).where("n > 1")


def x11_entities(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, _D).select("doc_id", "text")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), X.entities(F.col("text"), k).alias("found")) for k in ("date", "percent", "url", "email", "organisation")])
    return docs.select("doc_id", F.explode(kinds).alias("e")).select("doc_id", "e.kind", F.size("e.found").cast("long").alias("n"), F.array_join("e.found", "|").alias("found")).where("n > 0")


def x12_languages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _D).groupBy(X.detect_language(F.col("text")).alias("detected"), F.lower(F.substring("lang", 1, 2)).alias("stated")).agg(F.count(F.lit(1)).alias("n"))


def x14_body_length(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _D).where("text is not null").select("doc_id", F.length(X.strip_frontmatter(F.col("text"))).cast("long").alias("n"))


def x15_sanitized(s: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.concat(F.lit("api_key="), F.coalesce("doc_key", F.lit(""))), F.concat(F.lit("https://user:"), F.col("doc_key"), F.lit("@host/")))
    return table(s, d, _D).select("doc_id", X.sanitize(t).alias("clean"))


def x16_redacted(s: SparkSession, d: str) -> DataFrame:
    r = X.redact(F.substring("doc_key", 1, F.pmod("doc_id", F.lit(12)).cast("int")))
    return table(s, d, _D).select("doc_id", r.alias("shown"), X.is_masked(r).alias("masked"))


def x19_display_source(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _D).select("doc_id", X.display_source(X.frontmatter(F.col("text"))["source_file"], F.col("title"), F.col("rel_path")).alias("source_name"))


def x20_prefix_hashes(s: SparkSession, d: str) -> DataFrame:
    own = F.sha1(F.substring(F.col("text").cast("binary"), 1, 4096))
    return table(s, d, _D).where("text is not null").select("doc_id", own.alias("prefix_hash"), (F.lower("sha1") == own).alias("agrees"))


def x25_months(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _D).groupBy(F.date_format("indexed_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def x26_json_fields(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.min(F.to_json(F.struct(k.alias("k")))).alias("least"))


def x27_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _D).select("doc_id", X.human_size(F.col("file_size")).alias("size"))


def c2_frontmatter(s: SparkSession, d: str) -> DataFrame:
    m = X.frontmatter(F.col("text"))
    return table(s, d, _D).where(F.size(m) > 0).select("doc_id", m["title"].alias("title"), m["status"].alias("status"), m["keywords"].alias("keywords"))


def c3_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _D).select("doc_id", X.markdown_title(F.col("text"), F.col("rel_path")).alias("title"))


def c4_wikilinks(s: SparkSession, d: str) -> DataFrame:
    w = X.wikilinks(F.col("text"))
    return table(s, d, _D).where(F.size(w) > 0).select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(w, "|").alias("targets"))


def c7_sentences(s: SparkSession, d: str) -> DataFrame:
    x = X.sentences(F.col("content"))
    b = table(s, d, "parent_blocks").where("content is not null").select("parent_id", F.size(x).cast("long").alias("n"), F.array_max(F.transform(x, F.length)).cast("long").alias("longest"))
    return b.distinct()


def c8_fixed_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of 200 characters every 170, the fixed form of child chunks."""
    docs = table(s, d, _D).where("length(text) > 0")
    at = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(170))).alias("at")
    w = docs.select("doc_id", "text", at).select("doc_id", "at", F.substring("text", F.col("at") + 1, F.lit(200)).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("w")).alias("chars"), F.max(F.md5("w")).alias("last_hash"))


def c11_retrieval_text(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "parent_blocks")
    return b.select("parent_id", F.md5(X.retrieval_text(F.col("section_path"), F.col("content"))).alias("h")).distinct()


def c13_doc_ids(s: SparkSession, d: str) -> DataFrame:
    own = X.doc_id_of(F.col("rel_path"))
    return table(s, d, _D).select("doc_id", own.alias("derived"), (own == F.col("doc_key")).alias("agrees"))


def q1_terms(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "core_gold").select("id", "query").distinct()
    t = X.query_terms(F.col("query"))
    return q.select("id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("terms"))


def q7_question_types(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "core_gold").groupBy(X.question_type(F.col("query")).alias("question_type"), "category").agg(F.count(F.lit(1)).alias("n"))


def q8_question_tails(s: SparkSession, d: str) -> DataFrame:
    tail = r"(?:的)?(?:具体|主要|核心|相关)?(?:功能|特点|特性|能力|用途|信息|内容|情况)?(?:都)?(?:有哪些|有什么|是什么|是啥|如何|怎么样)[？?]?$"
    return table(s, d, "core_gold").select("id", F.regexp_replace("query", tail, "").alias("kept")).distinct()


def q10_grams(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "core_gold").select("id", "query").distinct()
    g = q.select("id", F.explode(X.query_terms(F.col("query"))).alias("t")).where(F.length("t") >= 3).select("id", F.explode(X.grams(F.col("t"))).alias("g"))
    return g.groupBy("id").agg(F.count_distinct("g").alias("n"))


def q11_routes(s: SparkSession, d: str) -> DataFrame:
    t = X.query_terms(F.col("query"))
    route = F.when((F.size(t) == 0) | F.exists(t, lambda x: F.length(x) < 3), "like").otherwise("fts")
    return table(s, d, "core_gold").groupBy("lang", route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in [x1_normalized_urls, x2_tracking_params, x3_hosts, j4_url_duplicates, x11_entities, x12_languages, x14_body_length, x15_sanitized, x16_redacted, x19_display_source, x20_prefix_hashes, x25_months, x26_json_fields, x27_sizes, c2_frontmatter, c3_titles, c4_wikilinks, c7_sentences, c8_fixed_windows, c11_retrieval_text, c13_doc_ids, q1_terms, q7_question_types, q8_question_tails, q10_grams, q11_routes]}

_CJK = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}"
URL_SQL = "regexp_replace(regexp_replace(lower(regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*', 0)) || regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || case when regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) in ('', '/') then '/' else '' end || case when contains(source_url, '?') then '?' || regexp_extract(source_url, '\\?([^#]*)', 1) else '' end, '#.*$', '')"
_FRONT = "'^---[ \\t\\r]*\\n((?s:.*?))\\n---[ \\t\\r]*(\\n|$)'"
_TRACK = ", ".join(f"'{t}'" for t in X.TRACKING)


def _in(words: list[str], c: str = "query") -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


_QTYPE = "case when " + _in(X.OVERVIEW_PHRASES) + " then 'coverage' " + " ".join(f"when {_in(w)} then '{n}'" for n, w in X.QUESTION_TYPES) + " when " + _in(X.COVERAGE_WORDS) + " then 'coverage' else 'general' end"
_TERMS = f"regexp_extract_all(query, '[A-Za-z0-9_+#.]+|[{_CJK}]+')"
_KINDS = " union all ".join(f"select doc_id, '{k}' kind, list_transform(regexp_extract_all(text, '{X.ENTITIES[k].replace(chr(39), chr(39) * 2)}'), lambda v: trim(v)) l from documents" for k in ("date", "percent", "url", "email", "organisation"))
_BODY = f"regexp_replace(text, {_FRONT}, '')"
_META = f"regexp_extract(text, {_FRONT}, 1)"


def _meta(key: str) -> str:
    return f"nullif(regexp_extract({_META}, '(?m)^{key}:[ \\t]*(.*?)[ \\t\\r]*$', 1), '')"


SQL = {
    "x1_normalized_urls": f"select distinct conv_id, {URL_SQL} as url from conversion_results where source_url is not null",
    "x2_tracking_params": f"""with p as (select unnest(string_split(regexp_extract(source_url, '\\?([^#]*)', 1), '&')) param from conversion_results where source_url is not null),
 n as (select split_part(param, '=', 1) as name, count(*) as n from p where param <> '' group by 1)
 select name, n, lower(name) in ({_TRACK}) or starts_with(lower(name), 'utm_') as tracking from n""",
    "x3_hosts": "select lower(regexp_extract(source_url, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host, count(distinct conv_id) as pages from conversion_results where source_url is not null group by 1",
    "j4_url_duplicates": f"select {URL_SQL} as url, count(distinct conv_id) as n, min(conv_id) as first_conv, max(conv_id) as last_conv from conversion_results where source_url is not null and ok group by 1 having count(distinct conv_id) > 1",
    "x11_entities": f"""with e as ({_KINDS}), f as (select doc_id, kind, list_filter(l, lambda v, i: list_position(l, v) = i)[1:6] found from e)
 select doc_id, kind, len(found) as n, array_to_string(found, '|') as found from f where len(found) > 0""",
    "x12_languages": f"""with c as (select lower(lang[1:2]) stated, coalesce(text, '') t, len(regexp_extract_all(coalesce(text, ''), '[{_CJK}]')) k, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_+#.\\-]{{2,}}')) w from documents)
 select case when trim(regexp_replace(t, '\\s', ' ', 'g')) = '' then 'unknown' when k >= 20 and k >= w * 2 then 'zh' when w >= 10 and k < w then 'en' when k > 0 and w > 0 then 'mixed' when k > 0 then 'zh' else 'en' end as detected, stated, count(*) as n from c group by all""",
    "x14_body_length": f"select doc_id, length({_BODY}) as n from documents where text is not null",
    "x15_sanitized": """with t as (select doc_id, coalesce(title, '') || ' api_key=' || coalesce(doc_key, '') || ' https://user:' || doc_key || '@host/' t from documents),
 a as (select doc_id, regexp_replace(t, '\\b(sk-[A-Za-z0-9_\\-]{6,})', '<redacted>', 'g') t from t), b as (select doc_id, regexp_replace(t, '(?i)\\b(bearer)\\s+([A-Za-z0-9_\\-.=]{8,})', '\\1 <redacted>', 'g') t from a),
 c as (select doc_id, regexp_replace(t, '(?i)\\b(api[_-]?key|token|secret|password)\\s*[:=]\\s*([^\\s,;''"]{6,})', '<redacted>', 'g') t from b)
 select doc_id, regexp_replace(t, '(?i)\\b([a-z][a-z0-9+.\\-]*://)([^/@\\s]{1,64})@', '\\1<redacted>@', 'g') as clean from c""",
    "x16_redacted": """with r as (select doc_id, left(doc_key, (doc_id % 12)::int) v from documents), s as (select doc_id, case when v = '' then '' when length(v) <= 4 then '<redacted>' when length(v) > 7 then left(v, 3) || '****' || right(v, 4) else '****' || right(v, 4) end as shown from r)
 select doc_id, shown, contains(shown, '<redacted>') or contains(shown, '****') and length(shown) < 40 as masked from s""",
    "x19_display_source": f"select doc_id, coalesce({_meta('source_file')}, nullif(trim(title), ''), regexp_extract(rel_path, '[^/]*$', 0)) as source_name from documents",
    "x20_prefix_hashes": "with h as (select doc_id, lower(sha1) s, sha1(unhex(left(hex(encode(text)), 8192))) p from documents where text is not null) select doc_id, p as prefix_hash, s = p as agrees from h",
    "x25_months": "select strftime(indexed_at, '%Y-%m') as month, count(*) as n from documents group by 1",
    "x26_json_fields": "select event_type, sum((props::json->>'k')::int) as total, min('{\"k\":' || (props::json->>'k') || '}') as least from events group by 1",
    "x27_sizes": "select doc_id, case when file_size < 1024 then file_size || ' B' when file_size < 1048576 then printf('%.1f KB', file_size / 1024.0) else printf('%.1f MB', file_size / 1048576.0) end as size from documents",
    "c2_frontmatter": f"select doc_id, {_meta('title')} as title, {_meta('status')} as status, {_meta('keywords')} as keywords from documents where regexp_matches({_META}, '(?m)^[^:\\s][^:]*:')",
    "c3_titles": f"""with b as (select doc_id, rel_path, {_META} m, regexp_replace(coalesce(text, ''), {_FRONT}, '') t from documents)
 select doc_id, coalesce(nullif(regexp_extract(m, '(?m)^(title|标题|name):[ \\t]*(.+?)[ \\t\\r]*$', 2), ''), nullif(regexp_extract(t, '(?m)^ {{0,3}}#[ \\t]+(.+?)[ \\t\\r]*$', 1), ''), nullif(trim(regexp_extract(t, '(?m)^[ \\t]*(\\S.*?)[ \\t\\r]*$', 1))[1:60], ''), regexp_replace(regexp_extract(rel_path, '[^/]*$', 0), '\\.[^.]*$', '')) as title from b""",
    "c4_wikilinks": """with w as (select doc_id, list_transform(regexp_extract_all(text, '\\[\\[([^\\[\\]|]+?)(?:\\|[^\\[\\]]*)?\\]\\]', 1), lambda v: trim(v)) l from documents), f as (select doc_id, list_filter(l, lambda v, i: list_position(l, v) = i) l from w)
 select doc_id, len(l) as n, array_to_string(l, '|') as targets from f where len(l) > 0""",
    "c7_sentences": """with m as (select parent_id, regexp_replace(regexp_replace(regexp_replace(content, '([。！？!?；;])\\s*', '\\1' || chr(1), 'g'), '(\\.)\\s+', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g') t from parent_blocks where content is not null),
 s as (select parent_id, list_filter(string_split(t, chr(1)), lambda v: trim(regexp_replace(v, '\\s', ' ', 'g')) <> '') l from m)
 select distinct parent_id, len(l) as n, list_max(list_transform(l, lambda v: length(v))) as longest from s""",
    "c8_fixed_windows": """with w as (select doc_id, text, unnest(range(0, length(text), 170)) a from documents where length(text) > 0), x as (select doc_id, substring(text, a + 1, 200) w from w)
 select doc_id, count(*) as n, sum(length(w))::bigint as chars, max(md5(w)) as last_hash from x group by 1""",
    "c11_retrieval_text": """with b as (select parent_id, section_path sp, regexp_replace(regexp_replace(coalesce(content, ''), '([\\x{3400}-\\x{9fff}])\\s+([\\x{3400}-\\x{9fff}])', '\\1\\2', 'g'), '([\\x{3400}-\\x{9fff}])\\s+([\\x{3400}-\\x{9fff}])', '\\1\\2', 'g') c from parent_blocks)
 select distinct parent_id, md5(case when coalesce(sp, '') <> '' then sp || chr(10) || chr(10) || c else c end) as h from b""",
    "c13_doc_ids": "select doc_id, left(sha1(regexp_replace(trim(replace(rel_path, '\\', '/')), '^/+', '')), 16) as derived, left(sha1(regexp_replace(trim(replace(rel_path, '\\', '/')), '^/+', '')), 16) = doc_key as agrees from documents",
    "q1_terms": f"with q as (select distinct id, query from core_gold) select id, len({_TERMS}) as n, array_to_string({_TERMS}, '|') as terms from q",
    "q7_question_types": f"select {_QTYPE} as question_type, category, count(*) as n from core_gold group by all",
    "q8_question_tails": "select distinct id, regexp_replace(query, '(?:的)?(?:具体|主要|核心|相关)?(?:功能|特点|特性|能力|用途|信息|内容|情况)?(?:都)?(?:有哪些|有什么|是什么|是啥|如何|怎么样)[？?]?$', '') as kept from core_gold",
    "q10_grams": f"""with q as (select distinct id, query from core_gold), t as (select id, unnest({_TERMS}) t from q), g as (select id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) g from t where length(t) >= 3)
 select id, count(distinct g) as n from g group by 1""",
    "q11_routes": f"select lang, case when len({_TERMS}) = 0 or len(list_filter({_TERMS}, lambda v: length(v) < 3)) > 0 then 'like' else 'fts' end as route, count(*) as n from core_gold group by all",
}
SQL = {k: v for k, v in SQL.items() if v}
