"""Core operators on small cases made by hand."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import markdown as M
from quern.functions import query as Q
from quern.functions import relation as R
from quern.functions import text as X
from quern.functions.keywords import keywords
from quern.functions.paths import address_kind, leaves_folder, safe_filename, url_problem
from quern.functions.relevance import Asked
from quern.operators import answer, chunking, evaluate, index, lexical, library, vector
from quern.operators.retrieve import expand_terms, resolve_terms, search
from quern.sources import convert as C
from quern.sources import html
from quern.sources.archive import Container, UnsafeArchive
from quern.sources.scan import documents_of, replace_notes, scan_notes
from quern.streaming import sync

NOTE = """---
title: Pump notes
status: kept
---
# Pumps

Intro text. Second sentence.

## 一、范围

Body of the first part.

2.1 点位

| a | b |
|---|---|
""" + "\n".join(f"| row {i} | {'x' * 60} |" for i in range(8))


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def test_sections_and_lines():
    parents = M.parse_note(NOTE)
    assert [p.section_path for p in parents] == ["Pumps", "Pumps > 一、范围", "Pumps > 一、范围 > 2.1 点位"]
    lines = NOTE.split("\n")
    for p in parents:
        assert lines[p.first_line - 1] == p.content.split("\n")[0]
        assert lines[p.last_line - 1] == p.content.split("\n")[-1]


def test_tables_keep_their_head():
    table = [c for p in M.parse_note(NOTE) for c in p.children if c.startswith("| a")]
    assert len(table) > 1 and all(c.split("\n")[1] == "|---|---|" for c in table)
    assert sum(c.count("| row") for c in table) == 8


def test_children_sizes_and_overlap():
    text = " ".join(f"Sentence number {i} of the text." for i in range(40))
    kids = M.children_of(text)
    assert all(len(k) <= M.CHILD + M.OVERLAP + 40 for k in kids)
    assert all(b[:10] in a for a, b in zip(kids, kids[1:]))
    long = M.children_of("x" * 1000)
    assert max(map(len, long)) == M.CHILD
    assert M.children_of("") == [] and M.parse_note("") == []


def test_long_fences_keep_line_numbers():
    body = "```\n" + "y\n" * 900 + "```\n\nafter"
    assert M.shorten_fences(body).count("\n") == body.count("\n")


def test_parse_notes_rows(spark):
    df = spark.createDataFrame([("a/b.md", NOTE, 1), ("c.md", None, 2), ("d.md", "", 3)], "rel_path string, text string, doc_id int")
    rows = chunking.children(chunking.parse_notes(df)).orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in rows] == list(range(len(rows)))
    assert len({r.doc_id for r in rows}) == 1


def test_evidence_units():
    u = M.evidence_units("| h | v |\n|---|---|\n| a | 1 |\n- one；two。\nplain")
    assert [k for _, k, _ in u] == ["table_header", "table_row", "sentence", "sentence", "line"]
    assert u[1][0].startswith("| h | v |")


def test_urls(spark):
    norm = lambda u: one(spark, X.normalize_url(F.col("u")), u=u)
    same = ["https://Example.org/a/", "https://example.org:443/a", "https://example.org/a#x", "https://example.org/a?utm_source=z", "https://example.org/a?gclid=1"]
    assert {norm(u) for u in same} == {"https://example.org/a"}
    assert norm("http://h/?b=2&a=1") == norm("http://h?a=1&b=2") == "http://h/?a=1&b=2"
    assert len({norm(u) for u in ["http://h/a", "http://h/A", "http://h/a?x=1", "https://h/a", "http://h:81/a"]}) == 5
    assert norm("not a url ") == "not a url"


def test_secrets(spark):
    assert one(spark, X.sanitize(F.col("t")), t="key sk-abcdef1234 and token: abcdefgh, https://u:p@h/x") == "key <redacted> and <redacted>, https://<redacted>@h/x"
    assert one(spark, X.redact(F.col("t")), t="sk-abcdefgh") == "sk-****efgh"
    assert one(spark, X.redact(F.col("t")), t="abc") == "<redacted>"


@pytest.mark.parametrize(("q", "kind"), [("观测点共有几个？", "quantity"), ("谁负责监测？", "person"), ("监测频率是怎么样的？", "coverage"), ("何时开工", "datetime"), ("功能有哪些", "coverage"), ("用什么型号", "model"), ("在哪里", "location"), ("abc", "general"), (None, "general")])
def test_question_types(spark, q, kind):
    assert spark.createDataFrame([(q,)], "q string").select(X.question_type(F.col("q"))).first()[0] == kind


def test_query_analysis(spark):
    def of(expr, q):
        got = spark.createDataFrame([(q,)], "q string").select(expr(F.col("q")).alias("x")).first().x
        return [(x.run if "run" in x else x.term, x.kind) if hasattr(x, "kind") else x for x in got] if isinstance(got, list) else got

    assert of(Q.strip_edges, "这个台风是什么") == "台风" and of(Q.strip_edges, "吗") == "吗"
    assert of(Q.content_terms, "台风杜鹃的路径") == ["台风杜鹃", "路径"]
    assert of(Q.content_terms, "是什么") == of(Q.content_terms, None) == []
    assert of(Q.content_terms, "What is FTS5 有机食品") == ["FTS5", "机食品"] and of(Q.written_terms, "What is FTS5 有机食品") == ["FTS5", "有机食品"]
    assert of(Q.analyzed, "观测方案中，观测点共有几个") == [("观测方案", "S"), ("观测点共有几个", "T")]
    assert of(Q.analyzed, "关于台风杜鹃") == [("台风杜鹃", "S")] and of(Q.analyzed, "在哪里") == [("在哪里", "T")]
    assert of(Q.analyzed, "Qwen 的功能有哪些") == [("Qwen", "T")]
    assert of(Q.highlight_terms, "水平位移怎么布置")[0] == "水平位移"
    assert of(Q.search_terms, "关于台风，台风路径") == [("台风", "S"), ("台风路径", "T")]


def test_relations():
    r = R.analyze_relation("大雾是否导致高速公路封闭？")
    assert (r.guarded, r.kind, r.anchor, r.target) == (True, "causal", "大雾", "高速公路封闭")
    assert R.analyze_relation("大雾有哪些影响？").guarded is False
    assert R.analyze_relation("负责人有哪些职责？").guarded is False
    blocks = [("p1", "大雾过程", "高速公路封闭了两小时。"), ("p2", "", "暴雨导致道路积水。监测由测量组负责。")]
    assert R.evaluate(r, blocks).rule == "in the anchor's section"
    assert R.evaluate(R.analyze_relation("大雾是否导致道路积水？"), blocks).verdict == "NO"
    assert R.evaluate(R.analyze_relation("监测由谁负责？"), blocks).owner == "测量组"
    assert R.evaluate(R.analyze_relation("哪个过程造成道路积水"), [("p", "", "暴雨造成道路积水")]).owner == "暴雨"
    assert R.evaluate(r, []).verdict == "INSUFFICIENT"


@pytest.mark.parametrize("at_once", [lexical.AT_ONCE, 0])
def test_match_terms_is_substring_search(spark, monkeypatch, at_once):
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    texts = [("1", "Banana bread"), ("2", "aaa 台风杜鹃"), ("3", None), ("4", ""), ("5", "NAN")]
    terms = ["nan", "aa", "台风", "z", "", None, "banana bread"]
    x = spark.createDataFrame(texts, "id string, text string")
    t = spark.createDataFrame([(v,) for v in terms], "term string")
    got = {(r.term, r.id) for r in lexical.match_terms(t, x, "id", "text").collect()}
    assert got == {(a, i) for a in terms if a for i, b in texts if b and a.lower() in b.lower()}
    counts = {(r.term, r.id): (r.f, r.size) for r in lexical.counted_terms(t, x, "id", "text").collect()}
    assert counts["nan", "1"] == (1, 12) and counts["aa", "2"] == (2, 8) and len(counts) == len(got)
    assert {r.term for r in lexical.present_terms(t, x, "text").collect()} == {a for a, _ in got}


def test_bm25_counts_overlaps(spark):
    assert one(spark, X.overlapping_count(F.col("t"), F.col("p")), t="aaaa", p="aa") == 3
    assert one(spark, X.overlapping_count(F.col("t"), F.col("p")), t="a.b.c", p=".") == 2


def test_relevance():
    asked = Asked("valve gauge", "general", ["valve", "gauge"], [2.0, 1.0], ["gauge"])
    # whole question 6, counts 2 * 2 + 1, heading 8, section 8, no pair without the space, short text 2
    assert asked.relevance("# Valve\nthe valve gauge", "valve") == pytest.approx(6 + 5 + 8 + 8 + 0 + 2)
    assert asked.relevance("", "") == 0 and asked.relevance("| x | gauge |", "") == pytest.approx(1 + 1)
    assert Asked("", "general", ["观测", "人员"], [1.0, 1.0], []).relevance("观测人员" * 60, "") == pytest.approx(120 + 3)
    near = Asked("", "quantity", ["观测点"], [1.0], ["观测点"])
    assert near.bonus("观测点共有8个", "") == 8 and near.bonus("观测点" + "很" * 20 + "8", "") == 0 and Asked("", "quantity", [], [], []).bonus("8", "") == 0
    model = Asked("", "model", ["水准仪"], [1.0], ["水准仪"])
    assert [model.bonus(*x) for x in (("水准仪 DS05", ""), ("DS05", "设备"), ("水准仪", ""), ("精度合格", ""), ("无", ""))] == [2.5, 1.2, 0.4, -0.8, 0.0]


def test_vectors(spark):
    v = vector.hash_embedding("Valve  gauge", 64)
    assert sum(x * x for x in v) == pytest.approx(1) and vector.hash_embedding("", 8).tolist() == [0.0] * 8
    assert (v == vector.hash_embedding("valve gauge", 64)).all()
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.id, r.rank) for r in vector.nearest(e, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vector.nearest(e, q.where("false"), 2).count() == 0


def test_prompt_budget():
    blocks = ["a" * 500 + "valve" + "b" * 500] * 6
    got = answer.prompt_blocks(blocks, ["valve"])
    assert sum(map(len, got)) <= answer.TOTAL and all("valve" in g for g in got[:4])
    assert answer.table_excerpt("| h |\n|---|\n| a |\n| valve |\n| b |\n| c |", ["valve"]).count("\n") == 4
    assert answer.highlight("Valve valves", ["valve"]) == "\x01Valve\x02 \x01valve\x02s"


def test_library(spark):
    m = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "doc_id string, collections array<string>")
    c = spark.createDataFrame([("b", ["z", "x", "z", "nope"]), ("c", ["nope"])], "doc_id string, collections array<string>")
    k = spark.createDataFrame([("x",), ("z",)], "id string")
    assert {r.doc_id: r.collections for r in library.assign(m, c, k).collect()} == {"a": ["x"], "b": ["z", "x"], "c": []}


def test_keywords():
    text = "台风杜鹃来了。台风杜鹃路径。台风预警，台风登陆，Valve valve valve"
    got = dict(keywords(text, "台风"))
    assert "台风" in got and "台风杜鹃" in got and "杜鹃" not in got
    assert keywords(None) == []


def test_paths():
    assert safe_filename("../a/con.txt") == "_con.txt" and safe_filename("") == "untitled"
    assert leaves_folder("a/../../b") and not leaves_folder("a/../b")
    assert address_kind("127.0.0.1") == "private" and address_kind("8.8.8.8") == "public" and address_kind("[::1]") == "private"
    assert url_problem("http://10.0.0.1/") == "address" and url_problem("ftp://x/") == "scheme" and url_problem("https://example.org/a") is None


def _named(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def test_office_files():
    style = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Own"><w:basedOn w:val="H"/></w:style></w:styles>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b|c")}</w:tr><w:tr>{cell("1")}</w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>'
    r = C.convert(_named({"word/document.xml": doc, "word/styles.xml": style}), "My_file.docx")
    assert r.ok and r.markdown == "# My file\n\n\n## Part\n| a | b\\|c |\n| --- | --- |\n| 1 |  |\n\nend"
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>'
    book = {"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}
    r = C.convert(_named(book), "t.xlsx")
    assert "| head | 列2 | x |" in r.markdown and "|  | 5 |  |" in r.markdown
    slide = lambda *t: f"<p {A}>" + "".join(f"<a:t>{x}</a:t>" for x in t) + "</p>"
    r = C.convert(_named({"ppt/slides/slide10.xml": slide("last"), "ppt/slides/slide2.xml": slide("first", "more")}), "s.pptx")
    assert r.markdown.index("first") < r.markdown.index("last") and "第 1 页 · first\n\nmore" in r.markdown
    book = {"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "O/a.html": "<p>one</p>", "O/b.html": "<p>two</p>"}
    assert C.convert(_named(book), "e.epub").markdown.endswith("one\n\ntwo")


def test_text_files():
    assert C.convert(b"a,b\n1\n\n", "x.csv").markdown.endswith("| a | b |\n| --- | --- |\n| 1 |  |")
    assert "```json\n{\n  \"a\": 1\n}" in C.convert(json.dumps({"a": 1}).encode(), "x.json").markdown
    assert C.convert(b"{", "x.json").warnings
    assert C.convert("中文".encode("gb18030"), "x.txt").markdown == "中文"
    assert C.convert(b"1\n00:00 --> 00:01\nhello\n", "x.srt").markdown.endswith("\n\nhello")
    assert C.convert(b"```x```", "a.py").markdown.startswith("# a\n\n````python")
    assert "- `b` x=\"1\" =t" in C.convert(b'<a><b x="1">t</b></a>', "a.xml").markdown
    assert C.convert(b"From: a@b\nSubject: Hi\n\nbody", "m.eml").markdown == "# Hi\n\n- **发件人**：a@b\nbody"
    for data, name in ((b"", "x.txt"), (b"x", "x.doc"), (b"x", "x.png"), (b"x", "x"), (b"x", "x.docx"), (b"%PDF", "x.pdf")):
        assert not C.convert(data, name).ok and C.convert(data, name).error
    assert len(C.capabilities()) >= 100


def test_archives_are_checked():
    with pytest.raises(UnsafeArchive):
        Container(_named({"../x": "y"}))
    with pytest.raises(UnsafeArchive):
        Container(_named({"big": "0" * (8 << 20)}))


def test_html():
    page = '<html><head><title>T &amp; U</title><meta name="author" content="me"><style>x</style></head><body><p>a <b>b</b></p><script>no</script><li>c</li><img src="i.png" srcset="j.png 2x, k.png"></body>'
    assert html.text_of(page) == "a b\nc"
    assert html.metadata_of(page) == {"title": "T & U", "author": "me"}
    assert html.assets_of(page) == ["i.png", "j.png", "k.png"]
    assert html.encoding_of('<meta charset="gbk">中'.encode("gbk")) == "gbk"


def test_convert_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.doc").write_text("x")
    rows = C.convert_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.ok for r in rows} == {"a.txt": True, "b.doc": False}


def test_scan_and_replace(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text(NOTE)
    (tmp_path / "n" / "b.txt").write_text("no")
    notes = scan_notes(spark, str(tmp_path))
    row = documents_of(notes).collect()
    assert [(r.rel_path, r.title, r.status) for r in row] == [("n/a.md", "Pump notes", "kept")]
    index = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "doc_id string, v int")
    fresh = spark.createDataFrame([("b", 9)], "doc_id string, v int")
    assert sorted(map(tuple, replace_notes(index, fresh, index.where("doc_id = 'c'")).collect())) == [("a", 1), ("b", 9)]


def test_sync_decisions(spark):
    cols = "rel_path string, mtime double, size long, prefix string"
    base = spark.createDataFrame([(n, 100.0, 5, "" if n == "blank" else "p") for n in ("same", "newer", "older", "grown", "blank", "edit", "gone")], cols)
    now = spark.createDataFrame([("same", 101.0, 5, "p"), ("newer", 200.0, 5, "p"), ("older", 1.0, 5, "p"), ("grown", 100.0, 6, "p"), ("blank", 100.0, 5, "p"), ("edit", 100.0, 5, "q"), ("fresh", 1.0, 1, "p")], cols)
    got = {r.rel_path: r.decision for r in sync.decide(base, now).collect()}
    assert got == {"same": "unchanged", "newer": "mtime-advanced", "older": "mtime-rewound", "grown": "size-changed", "blank": "baseline-missing", "edit": "same-length-edit", "fresh": "new"}
    assert {(r.rel_path, r.action) for r in sync.plan_sync(base, now).collect()} == {(n, "upsert") for n in ("newer", "grown", "blank", "edit", "fresh")} | {("gone", "delete")}
    state = sync.ChangeDetector._reason
    row = lambda m, s, p: type("R", (), {"mtime": m, "size": s, "prefix": p})
    assert state((100.0, 5, "p"), row(100.0, 6, "p")) == "size-changed" and state(None, row(1, 1, "")) == "new"


def test_folder_is_followed(spark, tmp_path):
    notes, seen = tmp_path / "notes", []
    notes.mkdir()
    (notes / "a.md").write_text("one")
    (notes / "b.md").write_text("two")
    run = lambda: sync.follow(spark, str(notes), str(tmp_path / "state"), lambda df, b: seen.append({(r.rel_path, r.reason) for r in df.collect()}), once=True).awaitTermination()
    run()
    (notes / "b.md").unlink()
    (notes / "a.md").write_text("longer")
    run()
    assert seen[0] == {("a.md", "new"), ("b.md", "new")}
    assert ("b.md", "vanished") in seen[-1] and any(p == "a.md" for p, _ in seen[-1])


def test_late_events_are_dropped(spark, tmp_path):
    """Events beyond the watermark don't change windows that are closed."""
    src = tmp_path / "in"
    src.mkdir()
    schema = "ts timestamp, event_type string, value double"
    rows = [["2024-01-01 00:05:00", "2024-01-01 01:30:00"], ["2024-01-01 03:30:00"], ["2024-01-01 00:06:00", "2024-01-01 05:30:00"]]
    out = str(tmp_path / "out")
    for i, part in enumerate(rows):
        spark.createDataFrame([(t, "x", 1.0) for t in part], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(src))
        q = sync.tumbling(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((str(r.start), r.n) for r in spark.read.parquet(out).collect())
    assert got[0] == ("2024-01-01 00:00:00", 1)


def test_streamed_changes_equal_the_batch_decision(spark, tmp_path):
    """Keyed state sees the same versions in the same order and decides alike."""
    cols = "rel_path string, mtime double, size long, prefix string"
    ticks = [[("a", 100.0, 5, "p"), ("b", 100.0, 5, "")], [("a", 200.0, 5, "p"), ("b", 100.0, 5, "q")], [("a", 200.0, 6, "p"), ("b", 100.0, 5, "q"), ("c", 1.0, 1, "z")]]
    src, seen = tmp_path / "in", []
    for rows in ticks:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(src))
        q = sync.detect_changes(spark.readStream.schema(cols).parquet(str(src))).writeStream.foreachBatch(lambda df, b: seen.append({r.rel_path: r.decision for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen[0] == {"a": "new", "b": "new"}
    assert {"a": "mtime-advanced", "b": "baseline-missing"} in seen
    assert {"a": "size-changed", "b": "unchanged", "c": "new"} in seen


def test_pair_order_is_exact(spark, monkeypatch):
    """Concordant pairs are counted without listing them, in blocks of any size."""
    rng = random.Random(4)
    for block in (evaluate.RANK_BLOCK, 3):
        monkeypatch.setattr(evaluate, "RANK_BLOCK", block)
        rows, want = [], {}
        for q, n in (("a", 1), ("b", 2), ("c", 37), ("d", 64)):
            order = list(range(1, n + 1))
            rng.shuffle(order)
            rows += [(q, i + 1, r) for i, r in enumerate(order)]
            want[q] = (n * (n - 1) // 2, sum(order[i] < order[j] for i in range(n) for j in range(i + 1, n)))
        got = {r.query_id: (r.pairs, r.same) for r in evaluate.concordant_pairs(spark.createDataFrame(rows, "query_id string, ra long, rb long")).collect()}
        assert got == want
    assert evaluate.concordant_pairs(spark.createDataFrame([], "query_id string, ra long, rb long")).count() == 0


def library_of(spark):
    blocks = [("n1:p0", "n1", "# 监测方案", "方案", 0), ("n1:p1", "n1", "监测频率为每天一次。", "方案 > 频率", 1), ("n1:p2", "n1", "遇雨加强监测。", "方案 > 频率 > 例外", 2), ("n1:p3", "n1", "设备清单", "方案 > 设备", 3), ("n2:p0", "n2", "valve gauge reading 41", "Log", 0), ("n3:p0", "gone", "valve of a note that is gone", "", 0)]
    b = spark.createDataFrame([(*x, 1, 2) for x in blocks], "parent_id string, doc_id string, content string, section_path string, ord int, source_start_line int, source_end_line int")
    c = b.select(F.concat("parent_id", F.lit(":c")).alias("chunk_id"), "parent_id", F.concat_ws("\n\n", "section_path", "content").alias("text"))
    return c, b, spark.createDataFrame([("n1", "监测方案", "a.md"), ("n2", "", "b.md")], "doc_id string, title string, rel_path string")


def test_search(spark):
    c, b, n = library_of(spark)
    q = spark.createDataFrame([("over", "监测频率是怎么样的"), ("word", "valve reading"), ("none", "是什么"), ("absent", "zebra"), (None, "valve")], "query_id string, query string").where("query_id is not null")
    v = vector.embed(c.select("chunk_id", "text"), "text", 64).select("chunk_id", "embedding")
    got = search(q, c, b, n, None)
    rows = {}
    for r in got.ranked.orderBy("query_id", "ref").collect():
        rows.setdefault(r.query_id, []).append(r)
    assert [r.parent_id for r in rows["over"]][:2] == ["n1:p1", "n1:p2"] and rows["over"][0].title == "监测方案"
    assert [r.parent_id for r in rows["word"]] == ["n2:p0"] and rows["word"][0].tier == "A" and rows["word"][0].title == "n2"
    assert "none" not in rows and "absent" not in rows
    routes = {r.query_id: (r.route, r.parents) for r in got.summary.collect()}
    assert routes["none"] == ("empty", 0) and routes["word"] == ("fts", 1) and routes["absent"] == ("like", 0)
    assert search(q.where("false"), c, b, n, v.where("false")).ranked.count() == 0
    terms = {(r.query_id, r.term) for r in got.terms.collect()}
    assert ("over", "频率") in terms and ("absent", "zebra") in terms


def test_search_with_vectors(spark):
    c, b, n = library_of(spark)
    v = vector.embed(c.select("chunk_id", "text"), "text").select("chunk_id", "embedding")
    q = spark.createDataFrame([("w", "valve gauge")], "query_id string, query string")
    got = search(q, c, b, n, v)
    reasons = {r.id: r.reason for r in got.chunks.collect()}
    assert reasons["n2:p0:c"] == "terms" and set(reasons.values()) <= {"terms", "meaning alone"}
    assert {r.parent_id for r in got.ranked.collect()} == {"n2:p0"}


def test_terms_are_cut_to_the_corpus(spark):
    c, _, _ = library_of(spark)
    q = spark.createDataFrame([("a", "请问监测频率如何规定"), ("b", "关于监测方案，设备清单在哪里"), ("c", None), ("d", "")], "query_id string, query string")
    terms = {}
    for r in resolve_terms(q, c, "text").orderBy("pos").collect():
        terms.setdefault(r.query_id, []).append((r.term, r.in_scope, r.in_target))
    assert [t for t, _, _ in terms["a"]] and all(len(t) >= 2 for t, _, _ in terms["a"])
    assert ("监测方案", True, False) in terms["b"] and "c" not in terms and "d" not in terms
    x = spark.createDataFrame([("1", "沉降观测点8个"), ("2", "观测点")], "id string, text string")
    assert expand_terms(spark.createDataFrame([("观测点",), ("没有",)], "term string"), x, "id", "text").orderBy("term").collect()[1].expanded == "沉降观测点"


def test_index_of_notes(spark):
    notes = spark.createDataFrame([("a.md", NOTE, 10, None), ("b.md", "Valve valve. 12 % on 2024-01-02", 5, None), ("c.md", None, 0, None)], "rel_path string, text string, file_size long, mtime timestamp")
    built = index.build_index(notes, 16)
    assert set(built) == {"documents", "parent_blocks", "chunks", "chunk_metadata", "chunks_vec", "doc_meta"}
    assert built["documents"].count() == 3 and built["doc_meta"].where("language = 'en'").count() >= 1
    assert built["chunks"].count() == built["chunks_vec"].count() == built["chunk_metadata"].count()
    fresh = index.build_index(notes.where("rel_path = 'b.md'").withColumn("text", F.lit("new text")), 16)
    after = index.update_index(built, fresh)
    assert after["documents"].count() == 3 and after["chunks"].where("content = 'new text'").count() == 1
    assert after["chunks_vec"].join(after["chunks"], "chunk_id", "left_anti").count() == 0
    files = spark.createDataFrame([("x/My.txt", b"hello", 5, None), ("x/b.doc", b"x", 1, None)], "path string, content binary, length long, modificationTime timestamp")
    assert [r.text for r in index.imported(files).collect()] == ['---\ntitle: "My"\nsource_file: "My.txt"\nsource_type: "text"\n---\n\nhello']
    assert index.manual_notes(spark.createDataFrame([("T", " ")], "title string, body string").withColumn("written_at", F.lit(None).cast("timestamp"))).count() == 0


def test_versions_and_spaces():
    state = index.version_state
    assert [state(v) for v in ("1.7", "1.6", "1.10", "", None, "x")] == ["ok", "upgrade", "downgrade", "unknown", "unknown", "unknown"] and state(None, exists=False) == "fresh"
    one = index.VectorSpace("onnx", "m", 512, "a", "t", "int8")
    assert one.problem(None) is None and one.problem(index.VectorSpace("onnx", "m", 512)) is None
    assert [one.problem(index.VectorSpace(*x)) for x in (("onnx", "m", 256), ("api", "m", 512), ("onnx", "m", 512, "b"))] == ["dimension", "model", "artifact"]
    assert index.merge_manifest({"own": "x", "data_version": "1"}, {"format": "f"}, 2) == {"format": "f", "own": "x", "data_version": "2"}
    with pytest.raises(ValueError):
        index.merge_manifest({"data_version": "3"}, {}, 2)
    assert index.choose_embedder("local_hash", ["local_hash"]) == "local_hash" and index.choose_embedder("api", ["ollama", "local_hash"]) == "ollama" and index.choose_embedder("api", ["local_hash"]) is None


def test_claims(spark):
    b = spark.createDataFrame([("p", "第一句话。 监测频率为每天一次；第三句\nValve 41 mm"), ("q", None)], "parent_id string, content string")
    c = spark.createDataFrame([("exact", "p", "1. 监测频率为每天一次。"), ("near", "p", "监测频率是每天两次"), ("none", "p", "完全不同的内容"), ("short", "p", "一次"), ("null", "p", None), ("lost", "q", "监测频率")], "claim_id string, parent_id string, claim string")
    got = {r.claim_id: r for r in index.match_claims(c, b).collect()}
    assert set(got) == {"exact", "near"} and got["exact"].mode == "exact" and got["near"].mode == "overlap"
    text = b.first().content
    assert text[got["exact"].start : got["exact"].end] == "监测频率为每天一次"
