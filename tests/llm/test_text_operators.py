"""Tokens, splitting, encoding repair, boilerplate, mixing."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import boilerplate as B
from quern.llm import labelled_lines as L
from quern.llm import mixing as X
from quern.llm import mojibake as M
from quern.llm import split as S
from quern.llm import tokenizer as T
from quern.llm.textarrays import points_of

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_public_encoder(reference, text):
    e = T.encoder()
    ids = e.encode_batch([text])[0]
    assert ids == reference(text)
    assert e.decode(ids) == text


@pytest.mark.parametrize("text", ["", " ", "\r\n \n", "<|endoftext|>", "don't we'll", "水位管 12号", "a" * 3000, "👷🏽‍♂️ é ﬁ", "\x00\x1f"])
def test_ids_of_odd_texts(reference, text):
    assert T.encoder().encode_batch([text])[0] == reference(text)


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", None), (1, "a b", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in T.encode(df).collect())
    assert got == [(1, got[0][1]), (1, got[0][1]), (2, []), (3, [])] and got[0][1]
    assert T.encode(df.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df.select("doc_id", "text")).collect()} == {1: 2, 2: 0, 3: 0}


def test_slices_cover_rows():
    texts = ["x" * n for n in (5, 0, 900_000, 3, 7)]
    assert [i for a, b in T.slices(texts, 10) for i in range(a, b)] == list(range(5))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .。\n#字́\r，"), max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces_hold_the_text(text, limit, overlap):
    cut = S.pieces(text, limit, overlap)
    assert all(len(p) <= limit for _, _, p in cut)
    assert "".join(text[a:b] for a, b, _ in cut) == text
    keep = min(overlap, limit // 2)
    for (a, _, _), (b, _, piece) in zip(cut, cut[1:]):
        assert a < b
        assert piece.startswith(text[max(0, b - keep) : b])


def test_pieces_end_at_strong_boundaries():
    text = "First part. It has two sentences.\n\n" + "Second part goes on and on, with a comma. End."
    ends = [text[b - 1] for _, b, _ in S.pieces(text, 60, 5)][:-1]
    assert ends == ["\n"]
    assert len(S.pieces("x" * 100_000, 100, 10)) >= 1000


def test_a_long_run_is_not_cut_if_it_fits():
    run = "x" * 60
    text = "one two three " + run + " four five"
    parts = [p for _, _, p in S.pieces(text, 70, 0)]
    assert any(run in p for p in parts) and "".join(parts) == text


def test_split_rows(spark):
    rows = [("a", "word " * 30, "p", 50, 10, "clash"), ("a", "word " * 30, "p", 50, 10, "clash"), ("b", None, None, 50, 10, ""), ("c", "", "p", 50, 10, ""), ("d", "x" * 50, None, 50, None, ""), ("e", "x" * 51, None, 50, None, ""), ("f", "x", "p", None, 1, "")]
    df = spark.createDataFrame(rows, "item_id string, content string, section_path string, max_chars int, overlap_chars int, piece_no string")
    got = S.split_items(df).collect()
    n = {i: sum(r.item_id == i for r in got) for i in "abcdef"}
    assert n["b"] == n["c"] == n["d"] == 1 and n["e"] == 2 and n["f"] == 0 and n["a"] == 2 * next(r.n_pieces for r in got if r.item_id == "a")
    assert S.split_items(df.where("false")).count() == 0


CORPUS = ["Reunião de manutenção — estação e galpão, instruções.", "Die Prüfung der Übergabe über Höhe und Maßnahmen.", "Don’t move the gate – it is 12.5 °C.", "关于水位管的监测记录，编号为准。请先封闭裂缝。"] * 50


@pytest.fixture(scope="module")
def pairs():
    x = np.concatenate([np.concatenate([points_of(t), np.zeros(1, np.uint32)]) for t in CORPUS])
    cell = np.concatenate([M.cells(x[:-1], x[1:])[(x[:-1] != 0) & (x[1:] != 0)], M.cells(x, np.zeros_like(x))[x != 0]])
    u, n = np.unique(cell, return_counts=True)
    logs = np.zeros(M.CELLS, np.uint16)
    logs[u] = M._logs(n)
    return M.PairTable(logs, 1e6)


CLEAN = ["Reunião de manutenção — estação", "Die Prüfung der Übergabe über Höhe", "Don’t move the gate – 12.5 °C", "关于水位管的监测记录，编号为准"]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "gb18030"])
def test_utf8_read_wrongly(pairs, wrong):
    hits = 0
    for t in CLEAN:
        try:
            bad = t.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        affected, back = M.repair(bad, pairs)
        assert affected, (t, bad)
        hits += back == t
        assert M.repair("ok so far " + bad, pairs)[0]
    assert hits >= 1


def test_other_directions(pairs):
    zh = CLEAN[3]
    assert M.repair(zh.encode("gb18030").decode("latin-1"), pairs) == (True, zh)
    twice = "Don’t".encode().decode("cp1252").encode().decode("cp1252")
    assert M.repair(twice, pairs) == (True, "Don’t")
    assert M.repair("Don\x92t", pairs)[0]
    assert M.repair("a � b", pairs) == (True, "a � b")
    assert M.repair("die Höhe".encode("cp1252").decode("mac_roman"), pairs)[0]


@pytest.mark.parametrize("text", [*CLEAN, *CORPUS[:4], "plain text", "", None, "MANUTENÇÃO E AVALIAÇÃO", "ño / café UF-1", "Δ7 ≈ 3.2 · λ=1.0 Ω → Склад", "👷🏽‍♂️ № 5 ‰", "m³ ± 0,5 °C", "Últimas publicações"])
def test_clean_texts_stay(pairs, text):
    assert M.repair(text, pairs) == (False, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_maximal_segments(values):
    """Against the definition: each has a positive sum, and no prefix or suffix that is not."""
    v = np.array(values, np.float64)
    got = M.segments(v)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    if len(v) and (v > 0).any():
        best = max(v[i:j].sum() for i in range(len(v)) for j in range(i + 1, len(v) + 1))
        assert max(v[a:b].sum() for a, b in got) == best
    for a, b in got:
        assert all(v[a:k].sum() > 0 for k in range(a + 1, b + 1))
        assert all(v[k:b].sum() > 0 for k in range(a, b))


def test_verdicts_belong_to_their_table(pairs):
    nothing = M.PairTable(np.zeros(M.CELLS, np.uint16), 1e9)
    proved = 0
    for word in ("水位", "记录", "裂缝", "编号"):
        bad = word.encode("gb18030").decode("latin-1")
        alone, known = M.invert(bad, nothing, "", ""), M.invert(bad, pairs, "", "")
        proved += alone is None and known == word
        assert M._remembered(bad, nothing, "", "") == alone
        assert M._remembered(bad, pairs, "", "") == known
    assert proved


def test_a_full_table(pairs):
    """Cells all filled by chance, as a corpus of all the web would, leave the verdicts as they are."""
    total = 1e13
    background = M._logs(np.full(M.CELLS, total * M.KNOWN / 4))
    logs = np.where(pairs.logs > 0, pairs.logs + M.STEP * np.log(total / pairs.total), 0)
    full = M.PairTable(np.maximum(background, logs).astype(np.uint16), total)
    zh = "水位管的读数记录在编号文件中"
    assert full.logs.min() > 0
    assert M.repair(zh.encode("gb18030").decode("latin-1"), full)[1] == zh
    assert M.repair(zh, full) == (False, zh) and M.repair("die Höhe", full) == (False, "die Höhe")
    assert M.repair("Don’t".encode().decode("cp1252"), full) == (True, "Don’t")
    assert M.repair("a � b", full)[0] and M.repair(M.LOST, full)[0]


def test_order_of_queries_does_not_matter(spark, tmp_path):
    """Encoding repair within the page queries leaves nothing behind for others in the same workers."""
    text = "die große Höhe der Häuser am Gerät. " * 4
    bad = text.encode("cp1252").decode("mac_roman")
    rows = [(i, True, "html", "t", bad if i % 2 else text, "h", None) for i in range(20)]
    spark.createDataFrame(rows, "conv_id long, ok boolean, kind string, title string, markdown string, host string, converted_at timestamp").write.parquet(f"{tmp_path}/conversion_results.parquet")
    spark.createDataFrame([(i, text, "ok") for i in range(50)], "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, title string").write.parquet(f"{tmp_path}/capture_results.parquet")
    first = {tuple(r) for r in M.p4_found(spark, str(tmp_path)).collect()}
    B.p2_found(spark, str(tmp_path)).count()
    again = {tuple(r) for r in M.p4_found(spark, str(tmp_path)).collect()}
    assert first == again == {("conversion_results", i) for i in range(1, 20, 2)}


def test_garbled_rows(spark):
    docs = spark.createDataFrame([(t, "x") for t in CORPUS] + [(None, None), ("", "")], "text string, cell string")
    table = M.pair_table(docs)
    rows = [("t", 1, "DonÃ¢â‚¬â„¢t"), ("t", 1, "DonÃ¢â‚¬â„¢t"), ("t", 2, "Don’t"), ("t", 3, None), ("t", 4, ""), ("t", 5, "x" * 200_000 + "é" * 3)]
    r = spark.createDataFrame(rows, "src_table string, row_id long, text string")
    assert {x.row_id for x in M.find_garbled(r, table).collect()} == {1}
    assert {x.restored for x in M.find_garbled(r, table).where("row_id = 1").collect()} == {"Don’t"}
    assert M.find_garbled(r.where("false"), table).count() == 0
    assert len(table.logs) == M.LEAST and (table.logs > 0).sum() * M.SPARSE < len(table.logs)
    empty = M.pair_table(docs.where("false"))
    assert empty.total == 1 and M.repair("", empty) == (False, "")


@pytest.fixture(scope="module")
def model():
    return B.model()


def test_accuracy_on_held_out_pages(model):
    right = total = 0
    for page in L.training_pages(150, seed=101):
        bad, _ = model.furniture("\n".join(t for t, _ in page))
        for i, (_, label) in enumerate(page, 1):
            if label >= 0:
                right += (i in bad) == bool(label)
                total += 1
    assert right / total > 0.98


PAGE = """Skip to content

- [Home](/)
- [News](/news)
- [Pricing](/pricing)

Home > News > The gate

# The gate

## Site layout

The crew measured the gate twice and found that the cookie of the test bench expires after 90 minutes, so they wrote the value down by hand.

- The first reading was 12.5 mm.
- The second reading was 13.1 mm.

| Code | Value |
|---|---|
| A-1 | 5 |

## Sources

1. [A report](https://other.example/1)

## Most read

- [Another note](/p/1)
- [A third note](/p/2)

Tags: gate, crew

Accept all
Manage preferences

Copyright 2020–2023 Tormir Works"""


def test_pages_of_unknown_wording():
    """Without any phrase or word it was trained on, form and neighbours still tell most furniture."""
    m = B.PageModel()
    m.use(B.NO_WORDING)
    hit = got = want = 0
    for page in L.training_pages(400, seed=77):
        f, at = m.features([t for t, _ in page])
        bad = m.tree.predict(f) >= B.CUT
        label = np.array([page[i][1] == 1 for i in at])
        hit, got, want = hit + (bad & label).sum(), got + bad.sum(), want + label.sum()
    print("unknown wording: recall", hit / want, "precision", hit / got)
    assert hit / want > 0.8 and hit / got > 0.95
    used = {B.FEATURES[k] for k in m.tree.feature if k >= 0}
    assert {"words", "link_density", "before_words", "after_words"} <= used


def test_a_page(model):
    lines = PAGE.split("\n")
    bad = {lines[i - 1] for i in model.furniture(PAGE)[0]}
    assert bad == {"Skip to content", "- [Home](/)", "- [News](/news)", "- [Pricing](/pricing)", "Home > News > The gate", "## Most read", "- [Another note](/p/1)", "- [A third note](/p/2)", "Tags: gate, crew", "Accept all", "Manage preferences", "Copyright 2020–2023 Tormir Works"}
    crlf = model.furniture(PAGE.replace("\n", "\r\n"))[0]
    assert crlf == model.furniture(PAGE)[0]


@pytest.mark.parametrize(("title", "more"), [("The gate", False), ("the  GATE", False), ("The gate - Tormir Works", True), ("(3) The gate – X", True), ("Home » News » The gate", True), ("", False)])
def test_titles(model, title, more):
    bad, lines = model.furniture(PAGE)
    own = model.own_title(lines, bad)
    assert own == "The gate"
    assert model.title_holds_more(title, own, model.feet(lines, bad)) is more


def test_boilerplate_rows(spark):
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, ""), (3, None), (4, "\n\n"), (5, "word " * 50_000)], "conv_id long, markdown string")
    titles = spark.createDataFrame([(1, "The gate - Tormir Works", 1), (1, None, 2), (2, "", 3), (3, "the gate", 4), (None, "x | y", 5), (9, "Home » x", 6)], "conv_id long, title string, own int")
    got = B.furniture_lines(df.withColumn("line_no", F.lit("clash")), titles).collect()
    assert {r.conv_id for r in got} == {1} and 0 in {r.line_no for r in got}
    assert {tuple(r) for r in B.furniture_lines(df).distinct().collect()} == {tuple(r) for r in got if r.line_no}
    assert B.furniture_lines(df, titles.where("false")).where("line_no = 0").count() == 0
    body = {r.conv_id: r.content for r in B.main_content(df).collect()}
    assert body[1].startswith("# The gate") and "Most read" not in body[1] and body[3] is None and body[2] == ""
    assert B.furniture_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutations(n):
    p = X.permute(np.arange(n), n, X.key_of("a", n))
    assert sorted(p.tolist()) == list(range(n))
    assert n < 10 or p.tolist() != list(range(n))


def test_allotment():
    assert X.allot(100, {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 1000}) == {"a": 50, "b": 50}
    assert X.allot(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}) == {"a": 10, "b": 90}
    assert X.allot(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert X.allot(100, {"a": 1.0}, {}) == {"a": 0}


def test_shards_add_up():
    totals = {"a": 1000, "b": 333, "c": 1}
    rows = list(X.draw_shards(totals, 5))
    for s, n in totals.items():
        own = [(a, k) for _, x, a, k in rows if x == s]
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))
    sizes = {}
    for shard, _, _, k in rows:
        sizes[shard] = sizes.get(shard, 0) + k
    assert all(v == X.SHARD for k, v in sizes.items() if k < max(sizes))


def test_shards_drawn_apart_are_those_drawn_together():
    totals = {"a": 100_000, "b": 33_333, "c": 12}
    rows = list(X.draw_shards(totals, 5))
    n = max(r[0] for r in rows) + 1
    assert [r for k in range(0, n + 7, 7) for r in X.draw_shards(totals, 5, k, k + 7)] == rows
    share = [r[3] for r in rows if r[1] == "b" and r[0] < n - 1]
    assert 20 < min(share) < max(share) < 110


def test_blocks_of_tokens(spark):
    docs = [(i, "s", "valve gate " * (40 * i)) for i in range(1, 40)] + [(100, None, "x"), (101, "s", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("m", "S", 1.0, 2, 1.5)], "mix_name string, source string, target_share double, max_repeats int, budget_fraction double")
    rows = X.mixed_blocks(df, t).collect()
    assert len({(r.shard, r.place) for r in rows}) == len(rows)
    of = {r.block: tuple(r.ids) for r in rows}
    assert all(of[r.block] == tuple(r.ids) for r in rows) and all(len(v) == X.BLOCK for k, v in of.items() if k < max(of))
    chosen = X.mix(df, t)
    assert sum(len(r.ids) for r in rows) == chosen.agg(F.sum("tokens_used")).first()[0]
    whole = chosen.where("uses = 2").count()
    assert 0 < whole < len(docs)


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    docs = [(i, ["Big", "big ", "small", "other", None][i % 5], " ".join(rng.choice(["valve", "gate", "crew", "水位"]) for _ in range(rng.randint(0, 900))), "clash") for i in range(400)]
    docs += [(1000, "small", None, ""), (1001, "small", "", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, n_tokens string")
    t = spark.createDataFrame([("m", "big", 0.7, 1, 0.4), ("m", "small", 0.2, 2, 0.4), ("m", "absent", 0.1, 3, 0.4), (None, "big", 0.5, 1, 0.5)], "mix_name string, source string, target_share double, max_repeats int, budget_fraction double")
    chosen = X.mix(df, t)
    rows = chosen.collect()
    most = {"big": 1, "small": 2}
    assert rows and all(r.uses <= most[r.source] and r.tokens_used <= r.uses * r.n_tokens for r in rows)
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    got = {r.source: r for r in X.shares(chosen, t).where("mix_name = 'm'").collect()}
    assert got["absent"].tokens == 0
    assert abs(got["big"].actual_share - 0.7 / 0.9) < 0.05 and abs(got["small"].actual_share - 0.2 / 0.9) < 0.05
    assert sorted(map(tuple, X.mix(df, t).collect())) == sorted(map(tuple, rows))
    assert X.mix(df.where("false"), t).count() == 0 and X.mix(df, t.where("false")).count() == 0


def test_blocks_hold_every_token(spark):
    sized = spark.createDataFrame([(i, "s", 10 * i) for i in range(1, 120)], "doc_id long, source string, n_tokens long")
    parts = X.in_blocks(X.lay_out(sized))
    per_doc = {r.doc_id: r.n for r in parts.groupBy("doc_id").agg(F.sum("part").alias("n")).collect()}
    assert per_doc == {i: 10 * i for i in range(1, 120)}
    full = [r.n for r in parts.groupBy("block").agg(F.sum("part").alias("n")).orderBy("block").collect()]
    assert all(n == X.BLOCK for n in full[:-1])


