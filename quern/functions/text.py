"""Scalar text functions as built-in expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"

# Question words that tell the type of a question, in the order in which they are tried.
QUESTION_TYPES = [
    ("quantity", ["多少", "几个", "几台", "几人", "几根", "几处", "几次", "几遍", "几条", "几件", "几组", "几套", "几层", "多大", "多长", "多重", "多高", "多厚", "数量", "共有", "总共", "一共", "合计", "总计", "共计"]),
    ("person", ["谁", "负责人", "姓名", "联系人", "哪位", "责任人", "由谁", "人员的名字"]),
    ("datetime", ["什么时候", "何时", "多久", "多长时间", "频率", "周期", "每几", "每隔", "几天", "几个月", "几日"]),
    ("model", ["型号", "规格", "什么仪器", "什么设备", "哪些仪器", "哪些设备"]),
    ("location", ["哪里", "在哪", "位置", "地点", "点位"]),
]
COVERAGE_WORDS = ["有哪些", "有什么", "都有什么", "哪些功能", "主要功能", "功能", "特点", "特性", "能力", "支持什么", "支持哪些", "用途", "总结一下", "介绍一下"]
OVERVIEW_PHRASES = ["是怎么样的", "是怎样的", "是什么样", "怎么样", "怎么规定", "怎么安排", "如何规定", "有哪些规定", "有什么规定", "有哪些要求", "什么要求", "要求是什么", "介绍一下", "说一下", "具体情况", "详细说明", "怎么回事", "包含哪些", "包括哪些", "有哪些内容"]
# Query parameters that only track.
TRACKING = ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "yclid", "twclid", "igshid", "mkt_tok", "mc_cid", "mc_eid", "_ga", "_gl", "ref_src", "ref_url", "spm", "scm", "share_token", "share_source", "from_source"]
# Patterns of entities; each type gives at most ENTITY_LIMIT.
ENTITIES = {
    "date": r"\d{4}\s*[-/年]\s*\d{1,2}\s*[-/月]\s*\d{1,2}\s*日?",
    "money": r"(?:[¥￥$]\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*(?:万元|亿元|万|亿|元|美元|人民币))",
    "percent": r"\d+(?:\.\d+)?\s*%",
    "url": r"https?://[^\s<>\"'）)】\]]+",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "organisation": rf"[{CJK}]{{2,12}}(?:公司|集团|研究院|研究所|大学|学院|医院|银行|事务所|管理局|委员会|协会|中心)",
}
ENTITY_LIMIT = 6
MASK = "<redacted>"
# Shapes of secrets in text, with what stands in their place.
SECRETS = [
    (r"\b(sk-[A-Za-z0-9_\-]{6,})", MASK),
    (r"(?i)\b(bearer)\s+([A-Za-z0-9_\-.=]{8,})", f"$1 {MASK}"),
    (r"(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*([^\s,;'\"]{6,})", MASK),
    (r"(?i)\b([a-z][a-z0-9+.\-]*://)([^/@\s]{1,64})@", f"$1{MASK}@"),
]
FRONT = r"(?s)\A---[ \t\r]*\n(.*?)\n---[ \t\r]*(?:\n|\z)"
SENTENCE_END = r"(?<=[。！？!?；;])\s*|(?<=\.)\s+|\n{2,}"


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether a text holds one of the parts."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def count_of(c: Column, part: Column) -> Column:
    """Occurrences of a part that don't overlap."""
    return F.when(F.length(part) > 0, ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def overlapping_count(c: Column, part: Column) -> Column:
    """Occurrences of a part, overlapping ones too: places from which it can be read."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(part) > 0, F.regexp_count(c, quoted)).otherwise(0)


def query_terms(q: Column) -> Column:
    """Runs of ASCII word characters or of Chinese characters."""
    return all_matches(F.coalesce(q, F.lit("")), rf"[A-Za-z0-9_+#.]+|[{CJK}]+")


def grams(t: Column, n: int = 3) -> Column:
    """All n-grams of a text in order; none if it is shorter."""
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>"))


def question_type(q: Column) -> Column:
    """Type of a question: an overview first, then the specific types, coverage only if none of them holds."""
    q = F.coalesce(q, F.lit(""))
    out = F.when(any_of(q, OVERVIEW_PHRASES), "coverage")
    for name, parts in QUESTION_TYPES:
        out = out.when(any_of(q, parts), name)
    return out.when(any_of(q, COVERAGE_WORDS), "coverage").otherwise("general")


def detect_language(t: Column) -> Column:
    """zh, en, mixed or unknown by Chinese characters and ASCII words."""
    t = F.coalesce(t, F.lit(""))
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]"))
    words = F.regexp_count(t, F.lit(r"[A-Za-z][A-Za-z0-9_+#.\-]{2,}"))
    return (
        F.when(F.trim(F.regexp_replace(t, r"\s", " ")) == "", "unknown")
        .when((cjk >= 20) & (cjk >= words * 2), "zh")
        .when((words >= 10) & (cjk < words), "en")
        .when((cjk > 0) & (words > 0), "mixed")
        .when(cjk > 0, "zh")
        .otherwise("en")
    )


def strip_frontmatter(t: Column) -> Column:
    return F.regexp_replace(t, FRONT, "")


def frontmatter(t: Column) -> Column:
    """The ``key: value`` lines of the front matter as a map; of repeated keys the last counts."""
    lines = F.split(F.regexp_extract(F.coalesce(t, F.lit("")), FRONT, 1), "\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(r"^[^:\s][^:]*:")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(x, r"^[^:]*:\s*|\s+$", "").alias("v")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p.k), F.map_from_arrays(F.array(p.k), F.array(p.v))))


def markdown_title(t: Column, path: Column) -> Column:
    """Title in the front matter, else the first top heading, else the first line with text (60 characters), else the file's stem."""
    t = F.coalesce(t, F.lit(""))
    meta = F.regexp_extract(F.regexp_extract(t, FRONT, 1), r"(?m)^(?:title|标题|name):[ \t]*(.+?)[ \t\r]*$", 1)
    body = strip_frontmatter(t)
    head = F.regexp_extract(body, r"(?m)^ {0,3}#[ \t]+(.+?)[ \t\r]*$", 1)
    first = F.substring(F.trim(F.regexp_extract(body, r"(?m)^[ \t]*(\S.*?)[ \t\r]*$", 1)), 1, 60)
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.coalesce(*[F.when(x != "", x) for x in (meta, head, first)], stem)


def wikilinks(t: Column) -> Column:
    """Targets of ``[[target|alias]]``, each once, in order."""
    return F.array_distinct(F.transform(all_matches(F.coalesce(t, F.lit("")), r"\[\[([^\[\]|]+?)(?:\|[^\[\]]*)?\]\]", 1), lambda x: F.trim(x)))


def sentences(t: Column) -> Column:
    """A text cut after sentence ends or at blank lines; blank pieces are dropped."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != "")


def retrieval_text(section: Column, content: Column) -> Column:
    """Section path and content, with spaces between Chinese characters collapsed."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])", "")
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(section, F.lit("\n\n"), body)).otherwise(body)


def doc_id_of(path: Column) -> Column:
    """Identity of a note: the first 16 hex digits of the hash of its cleaned relative path."""
    clean = F.regexp_replace(F.trim(F.translate(path, "\\", "/")), "^/+", "")
    return F.substring(F.sha1(clean.cast("binary")), 1, 16)


def entities(t: Column, kind: str) -> Column:
    """Entities of one kind, each once, in order, at most ``ENTITY_LIMIT``."""
    return F.slice(F.array_distinct(F.transform(all_matches(F.coalesce(t, F.lit("")), ENTITIES[kind]), lambda x: F.trim(x))), 1, ENTITY_LIMIT)


def sanitize(t: Column) -> Column:
    """A text without secrets."""
    for pattern, by in SECRETS:
        t = F.regexp_replace(t, pattern, by)
    return t


def redact(v: Column, tail: int = 4) -> Column:
    """A secret with its first three and last four characters, if it is long enough for that."""
    v = F.coalesce(v, F.lit(""))
    end = F.right(v, F.lit(tail))
    return F.when(v == "", "").when(F.length(v) <= tail, MASK).when(F.length(v) > tail + 3, F.concat(F.left(v, F.lit(3)), F.lit("****"), end)).otherwise(F.concat(F.lit("****"), end))


def is_masked(v: Column) -> Column:
    v = F.coalesce(v, F.lit(""))
    return v.contains(MASK) | (v.contains("****") & (F.length(v) < 40))


def is_tracking(name: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (n == "") | n.startswith("utm_") | n.isin(TRACKING)


def normalize_url(u: Column) -> Column:
    """One form for addresses of the same page: scheme and host lower, no default port, fragment or tracking, sorted query, no trailing slash."""
    raw = F.trim(F.coalesce(u, F.lit("")))
    whole = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(raw, whole, i)
    scheme, user, host, port, path, query = (part(i) for i in range(1, 7))
    scheme = F.lower(scheme)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    netloc = F.concat(F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), F.lower(host), F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(decoded(F.substring_index(x, "=", 1)).alias("k"), F.when(x.contains("="), decoded(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p.k)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p.k), F.lit("="), F.url_encode(p.v))), "&")
    clean = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "(?<=.)/+$", ""))
    clean = F.when(clean == "", "/").otherwise(clean)
    url = F.concat(scheme, F.lit("://"), netloc, clean, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(raw.rlike(whole), url).otherwise(raw)


def host_of(u: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def display_source(source_file: Column, title: Column, path: Column) -> Column:
    """The imported file's name, else the title, else the path's last part."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(blank(source_file), blank(title), F.substring_index(F.coalesce(path, F.lit("")), "/", -1))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves a figure of at least one."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for unit, k in (("KB", 1), ("MB", 2), ("GB", 3)):
        out = out.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(n / float(1024**4), 1)), F.lit(" TB")))


def snippet(t: Column, term: Column, width: int = 140, before: int = 46) -> Column:
    """A stretch of the text around the first occurrence of a term, from the start if there is none."""
    start = F.greatest(F.position(term, t) - 1 - before, F.lit(0))
    return F.substring(t, start + 1, F.lit(width))
