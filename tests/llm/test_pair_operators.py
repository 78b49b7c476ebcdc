"""Shared spans, near-duplicates and overlaps across splits, against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import contamination as C
from quern.llm import neardup as N
from quern.llm import spans as P
from quern.llm.fmindex import FMIndex, WaveletMatrix, suffix_order
from quern.llm.textarrays import gram_hashes, points_of, rolling_min

WORDS = "valve gate crew pump sensor report river tunnel station value reading signed filed moved sealed 水位管 裂缝计 记录 编号 仓库".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(999))]) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé水", max_size=60), st.integers(1, 9))
def test_gram_hashes(text, k):
    h = gram_hashes(points_of(text), k)
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    assert len(h) == len(grams)
    assert all((a == b) == (x == y) for (a, x), (b, y) in combinations(zip(grams, h.tolist()), 2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 12))
def test_rolling_min(values, width):
    if width <= len(values):
        assert rolling_min(np.array(values), width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_suffix_order(values):
    t = np.array([*values, 0])
    got = [t[i : i + 256].tolist() for i in suffix_order(t)]
    assert got == sorted(t[i:].tolist() for i in range(len(t)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=150))
def test_wavelet_ranks(values):
    s = np.array(values)
    wm = WaveletMatrix(s, 13)
    for c in range(13):
        at = np.arange(len(s) + 1)
        assert wm.rank(np.full(len(at), c), at).tolist() == [int((s[:i] == c).sum()) for i in at]


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_shared_windows(data):
    segments = data.draw(st.lists(st.text(alphabet="ab", max_size=25), min_size=1, max_size=6))
    owners = data.draw(st.lists(st.sampled_from([1, 2, FMIndex.MANY]), min_size=len(segments), max_size=len(segments)))
    width = data.draw(st.integers(2, 7))
    got = FMIndex([points_of(s) for s in segments], np.array(owners)).shared_windows(width)
    found = {(int(i), k) for i, a, b in zip(*got) for k in range(a, b + 1)}
    want = {(i, k) for i, s in enumerate(segments) for k in range(len(s) - width + 1) if owners[i] == -1 or any(s[k : k + width] in t and (owners[j] != owners[i] or owners[j] == -1) for j, t in enumerate(segments))}
    assert found == want


def brute_spans(docs, n=P.SPAN):
    seen: dict[str, set] = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(d)
    out = {}
    for d, t in docs:
        chars: set[int] = set()
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                chars.update(range(k, k + n))
        if chars:
            out.setdefault(d, set()).update(chars)
    return {d: len(c) for d, c in out.items()}


def span_docs():
    rng = random.Random(5)
    passage, longer = prose(rng, 40)[:230], prose(rng, 900)
    docs = [(i, prose(rng, 60)) for i in range(30)]
    for i in range(0, 12, 2):
        docs[i] = (i, docs[i][1][:150] + passage[i : i + 215] + docs[i][1][150:])
    docs += [(100, longer), (101, "x" + longer[100:2000] + "y"), (102, longer[-300:-100]), (103, "a" * 900), (104, "b" + "a" * 450), (105, passage[:199]), (106, None), (107, ""), (108, "\r\n" * 150), (109, docs[20][1]), (100, longer)]
    twice = prose(rng, 50)
    return [*docs, (200, twice + twice)]


def test_spans_equal_brute_force(spark, monkeypatch):
    docs = span_docs()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, h string")
    want = brute_spans(docs)
    for heavy in (P.HEAVY, 1):
        monkeypatch.setattr(P, "HEAVY", heavy)
        spans = P.shared_spans(df).cache()
        got = {r.doc_id: r.n for r in spans.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n")).collect()}
        assert got == want and 200 not in got
        assert all(r.end_char - r.start_char >= P.SPAN for r in spans.collect())
    cover = {r.doc_id: r for r in P.coverage(spans, df.select("doc_id", "text").distinct()).collect()}
    assert (cover[106].n_chars, cover[106].shared_share) == (0, 0.0) and cover[102].shared_share == 1.0


@pytest.mark.parametrize("span", [2, 31, 300])
def test_spans_of_other_lengths(spark, span):
    docs = span_docs()
    df = spark.createDataFrame([(d, t[:4000] if t else t) for d, t in docs][-20:], "doc_id long, text string")
    got = {r.doc_id: r.n for r in P.shared_spans(df, span=span).groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n")).collect()}
    assert got == brute_spans([(r.doc_id, r.text) for r in df.collect()], span)


def test_a_passage_in_many_contexts(spark, monkeypatch):
    """A part never grows with the number of contexts of a passage."""
    monkeypatch.setattr(P, "HEAVY", 20)
    rng = random.Random(3)
    passage = prose(rng, 60)[:215]
    docs = [(i, prose(rng, 30) + passage[i % 3 : 213 + i % 3] + prose(rng, 30)) for i in range(90)] + [(i, prose(rng, 30) + passage[:199] + prose(rng, 30)) for i in range(100, 130)]
    got = {r.doc_id: r.n for r in P.shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n")).collect()}
    assert got == brute_spans(docs) and len(got) >= 90


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.shared_spans(empty).count() == 0
    assert P.shared_spans(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0


def test_a_passage_in_a_third_of_all(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    docs = [(i, (passage if i % 3 == 0 else "") + " " + prose(rng, 30)) for i in range(240)]
    got = {r.doc_id for r in P.shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == set(brute_spans(docs))


def grams_of(t):
    return {t[i : i + N.GRAM] for i in range(len(t) - N.GRAM + 1)}


def brute_pairs(rows):
    out = set()
    for table in {t for t, _, _ in rows}:
        own = {}
        for t, i, x in rows:
            if t == table and i is not None and x is not None and len(n := N.normal(x)) >= N.MIN_CHARS:
                own.setdefault(i, []).append(grams_of(n))
        for (i, a), (j, b) in combinations(own.items(), 2):
            if any(len(x & y) / len(x | y) >= N.THRESHOLD for x in a for y in b):
                out.add((table, min(i, j), max(i, j)))
    return out


def near_rows():
    rng = random.Random(11)
    base = [prose(rng, rng.choice([45, 60, 200])) for _ in range(40)]
    rows = [("documents", f"d{i}", t) for i, t in enumerate(base)]
    for i in range(0, 30, 2):
        w = base[i].split(" ")
        for k in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append(("documents", f"e{i}", "  " + " ".join(w).upper()))
    rows += [("documents", "c1", base[1]), ("documents", "c2", base[1].replace(" ", "\n ")), ("documents", "c2", base[1]), ("parent_blocks", "d1", base[1]), ("parent_blocks", "q1", base[1] + " more"), ("documents", None, base[1]), ("documents", "n", None), ("documents", "s", "short"), ("documents", "s2", "short"), ("documents", "same", "a" * 400), ("documents", "same2", "a" * 700)]
    return rows


@pytest.mark.parametrize("crowd", [N.CROWD, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    rows = near_rows()
    df = spark.createDataFrame(rows, "src_table string, id string, text string")
    got = {tuple(r) for r in N.expand(*N.near_duplicates(df)).collect()}
    assert got == brute_pairs(rows)


@pytest.mark.parametrize("block", [2000, 50])
def test_crowded_element_alone_pairs_groups(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block, raising=False)
    # Groups share element 7 and no other; every third is too large, one differs in its bits, ten share another element.
    rows = [(g, "t", 900 if g % 3 == 0 else 300, [7, *range(100 * g, 100 * g + 5)], -1 if g == 1 else 0) for g in range(1, N.CROWD + 30)] + [(g, "t", 300, [8, 100 * g], 0) for g in range(800, 810)]
    sk = spark.createDataFrame(rows, "grp long, src_table string, size int, elements array<long>, bits long")
    got = [tuple(r) for r in N.group_pairs(sk).collect()]
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[2:3] + a[4:] == b[2:3] + b[4:] and a[3][0] == b[3][0]}
    assert set(got) == want and len(got) == len(want)


def test_hot_copies_are_linked_through_one(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 50)
    rng = random.Random(2)
    text, other = prose(rng, 60), prose(rng, 60)
    rows = [("t", f"a{i:03}", text) for i in range(100)] + [("t", f"b{i:03}", text + " end") for i in range(3)] + [("t", f"z{i:03}", other) for i in range(2)]
    got = {tuple(r) for r in N.expand(*N.near_duplicates(spark.createDataFrame(rows, "src_table string, id string, text string"))).collect()}
    assert {("t", "a000", f"a{i:03}") for i in range(1, 100)} <= got
    assert ("t", "a000", "b000") in got and ("t", "z000", "z001") in got
    linked = {"a000"}
    for _ in range(3):
        linked |= {y for _, x, y in got if x in linked} | {x for _, x, y in got if y in linked}
    assert len(linked) == 103


def test_no_records(spark):
    empty = spark.createDataFrame([], "src_table string, id string, text string")
    assert N.expand(*N.near_duplicates(empty)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    for _ in range(20):
        a = N.normal(prose(rng, 80))
        w = a.split(" ")
        w[3] = "zzz"
        b, other = " ".join(w), N.normal(prose(rng, 80))
        sizes, e, _ = N.signatures([a, b, other, a])
        assert N.jaccard(N.grams(a), N.grams(b)) > 0.9 and (e[0] == e[1]).sum() >= 8
        assert (e[0] == e[2]).sum() <= 2 and (e[0] == e[3]).all()
        assert sizes.tolist() == [len(grams_of(x)) for x in (a, b, other, a)]
    assert [x.shape for x in N.signatures(["a" * 300])] == [(1,), (1, 2 * N.BINS // N.ROWS), (1,)]


TRAIN = [
    ("t1", "According to the notes, what is the repair cost of the crack gauge no. 1478 at Hareltha Tunnel H?"),
    ("t2", "根据记录，墨沅澜车站丙区的1030号样本架的负责人是多少？"),
    ("t3", "Which page records the unit price for roof truss number 543 in the Ushgallis Depot B file?"),
    ("t4", "Wie lautet laut Notiz das Prüfintervall für Einlaufrechen Nr. 353 in Gallismir Becken A?"),
]
SAME = [
    ("e1", "Please tell me: accoding to the notes, what's the repair cost of the crack gauge no. １４７８ at hareltha tunnel h ??", "t1"),
    ("e2", "请问墨沅澜车站丙区的1030号样本架，根据记录负责人是多少", "t2"),
    ("e3", "In the Ushgallis Depot B file, which page records the unit price for roof truss number 543?", "t3"),
    ("e4", "Kurze Frage – wie luatet laut Notiz das pruefintervall".replace("pruefintervall", "Prüfintervall") + " für Einlaufrechen Nr. 353 in Gallismir Becken A", "t4"),
]
OTHER = [
    ("o1", "According to the notes, what isn't the repair cost of the crack gauge no. 1478 at Hareltha Tunnel H?"),
    ("o2", "According to the notes, what is the repair cost of the crack gauge no. 1479 at Hareltha Tunnel H?"),
    ("o3", "According to the notes, what is the repair cost of the crack gauge no. 1478 at Hareltha Tunnel B?"),
    ("o4", "根据记录，墨沅澜车站丙区的1030号样本架的单价是多少？"),
    ("o5", "Which page never records the unit price for roof truss number 543 in the Ushgallis Depot B file?"),
    ("o6", ""),
    ("o7", None),
]


def questions(spark):
    filler = [(f"f{i}", "train", "train", "s", q.replace("1478", str(2000 + i)).replace("1030", str(5000 + i)).replace("543", str(7000 + i)).replace("353", str(9000 + i))) for i in range(150) for _, q in TRAIN]
    filler = [(f"{i}{k}", *r[1:]) for k, r in enumerate(filler) for i in [r[0]]]
    rows = [(i, "train", "train", "s", q) for i, q in TRAIN] + [(TRAIN[0][0], "train", "train", "s", TRAIN[0][1])] + filler
    rows += [(i, "eval", "test", "s", q) for i, q, _ in SAME] + [(i, "eval", "dev", None, q) for i, q in OTHER]
    return spark.createDataFrame(rows, "id string, side string, split string, source string, query string").withColumn("key", F.lit("clash"))


def test_overlaps(spark):
    got = {(r.train_id, r.eval_id) for r in C.expand(*C.overlaps(questions(spark))).collect()}
    assert got == {(t, e) for e, _, t in SAME}


def test_no_questions(spark):
    members, pairs = C.overlaps(questions(spark).where("false"))
    assert C.expand(members, pairs).count() == 0


def test_hot_question(spark, monkeypatch):
    monkeypatch.setattr(C, "EXPAND", 20)
    q = TRAIN[0][1]
    rows = [(f"t{i}", "train", "train", "s", q) for i in range(30)] + [(f"e{i}", "eval", "dev", "s", q) for i in range(10)]
    got = {(r.train_id, r.eval_id) for r in C.expand(*C.overlaps(spark.createDataFrame(rows, "id string, side string, split string, source string, query string"))).collect()}
    assert {t for t, _ in got} == {f"t{i}" for i in range(30)} and {e for _, e in got} == {f"e{i}" for i in range(10)}
    assert len(got) < 60


def test_hot_question_in_many_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(C, "EXPAND", 20)
    monkeypatch.setattr(C, "BLOCK", 4, raising=False)
    q, again = TRAIN[0][1], TRAIN[1][1]
    train = [(f"t{i}", "train", "s", q + " " * i) for i in range(10)] + [(f"u{i}", "train", "s", again) for i in range(30)]
    # One evaluation question has two texts, which ask different things.
    dev = [(f"e{i}", "dev", None, q.lower() + " " * i) for i in range(6)] + [(f"f{i}", "test", "s", again) for i in range(10)] + [("e0", "dev", None, again)]
    for name, rows in (("core_gold", train + dev), ("holdout_b_gold", dev[:0])):
        spark.createDataFrame(rows, "id string, split string, source string, query string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in C.p3_found(spark, str(tmp_path)).collect()}
    assert {(f"e{k}", f"t{i}") for i in range(10) for k in range(6)} <= got
    assert {tuple(r) for r in C.p3_report(spark, str(tmp_path)).collect()} == {("dev", None, 6, 6, 90), ("test", "s", 10, 10, 300)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_distance(a, b):
    def slow(x, y):
        d = {(i, j): i or j for i in range(len(x) + 1) for j in range(len(y) + 1) if not i or not j}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x), len(y)]

    assert C.distance(a, b, 2) == min(slow(a, b), 3)


def test_recall_just_above_the_threshold():
    """Of pairs between the threshold and 0.8, how many share an element and pass the filters."""
    rng = random.Random(21)
    pairs = []
    while len(pairs) < 1500:
        a = N.normal(prose(rng, rng.choice([50, 120, 300])))
        w = a.split(" ")
        for k in range(0, len(w), rng.choice([12, 14, 16])):
            w[k] = "".join(rng.choice("abcdefgh") for _ in range(6))
        b = " ".join(w)
        if N.THRESHOLD <= N.jaccard(N.grams(a), N.grams(b)) < 0.8:
            pairs.append((a, b))
    _, e, bits = N.signatures([t for p in pairs for t in p])
    alike = np.bitwise_count(~(bits[0::2] ^ bits[1::2]).view(np.uint64))
    found = [len(np.intersect1d(e[2 * k], e[2 * k + 1])) > 0 and alike[k] >= N.BITS for k in range(len(pairs))]
    print("recall", sum(found) / len(found))
    assert sum(found) / len(found) >= 0.98


def test_many_texts_of_one_group(spark, monkeypatch):
    """A group is parted when its texts are many, and no pair is lost."""
    monkeypatch.setattr(N, "TEXTS", 3)
    rows = near_rows()
    texts = [(t, i, x) for t, i, x in rows if x]
    sk = N.sketches(spark.createDataFrame(texts, "src_table string, id string, text string")).withColumn("grp", F.lit(7).cast("long") + F.length("src_table"))
    got = N.parted(sk)
    most = got.select("grp", "text_key").distinct().groupBy("grp").count().agg(F.max("count")).first()[0]
    assert got.count() == sk.count() and most < sk.select("text_key").distinct().count() / 3
    df = spark.createDataFrame(rows, "src_table string, id string, text string")
    assert {tuple(r) for r in N.expand(*N.near_duplicates(df)).collect()} == brute_pairs(rows)


@pytest.mark.parametrize("block", [1000, 3])
def test_near_codes_equal_brute_force(spark, monkeypatch, block):
    """Each pair within the radius once, whether its blocks are crowded or not."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(120):
        code = base[i % 6]
        for b in rng.sample(range(64), rng.randint(0, 4)):
            code ^= 1 << b
        rows.append(("train" if i % 4 else "eval", i, code - (1 << 64) if code >> 63 else code))
    got = [tuple(r) for r in C.near_codes(spark.createDataFrame(rows, "side string, cls long, code long")).collect()]
    want = {(i, j) for s, i, a in rows for t, j, b in rows if (s, t) == ("train", "eval") and ((a ^ b) & (1 << 64) - 1).bit_count() <= C.RADIUS}
    assert set(got) == want and len(got) == len(want) > 100
