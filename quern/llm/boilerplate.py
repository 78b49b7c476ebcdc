"""Page boilerplate mixed with main content.

A page is a row of lines; lines without a blank one between them are a block. Each
line has its number of words, its link density and how much of its wording is known
from the labelled table, and the same of the lines and blocks beside it. A decision
tree trained on the small labelled table tells furniture from article. A third of
the training pages is seen without any known wording, so the tree judges pages of
sites that word their furniture otherwise by form and neighbours alone. A page is
judged by itself, in one pass without shuffle, however many pages there are.

A page's own title is its first top heading that is not furniture. A second tree,
trained on titles of the labelled table, tells by how a captured title compares
with the own one, by its parts and marks, whether it holds more.

Defined results: null and empty pages have no lines; blank lines are neither
furniture nor article. Repeated rows and pages converted again are judged alike.
Null titles are no titles. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import labelled_lines as L
from quern.llm.mojibake import PairTable, repair
from quern.llm.tree import DecisionTree
from quern.operators.skew import merged
from quern.session import table, write_once

#: Pages of the labelled table the tree is trained on (the bound of the sample).
TRAINING_PAGES = 2100
#: Share of the known phrases that is hidden in a third of the training pages; in another third all are.
HIDDEN = 0.15
#: A line is furniture if at least this share of its leaf is: losing text of the article is the worse error.
CUT = 0.8

_LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\n]*)\)")
_BUTTON = re.compile(r"\[([^\]\n]{1,40})\](?!\()")
_MARK = re.compile(r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s*)+")
_PARTS = re.compile(r"\s*[·|»]\s*|\s+[>/–]\s+|\s{2,}|(?<=[.。])\s*(?=\S)|\]\s*\[")
_WORD = re.compile(r"[^\W\d_]+|©|↑")
_CJK = re.compile("[㐀-鿿]")
_END = re.compile(r"[.。!?！？;；”»\"]\s*$")
_DIGITS = re.compile(r"\d+")
_COLON = re.compile(r"\s*([^:：\d]{2,24}?)\s?[:：]\s*")
_YEAR = re.compile(r"\b(?:19|20)\d\d\b")
_TITLE_PARTS = re.compile(r"\s+[|–·-]\s+|\s+::\s+|_|\s+»\s+")
_TITLE_LEAD = re.compile(r"([^:：]{3,40}):\s+\S")
_FOOT = re.compile(r"©|copyright|\d{4}", re.I)
#: Signs that text may be garbled; only such lines are repaired before they are judged.
_STRANGE = re.compile("[ÂÃâ√Γ├┬âÐÑВГ锛鈥銆鍏鐨闃Ã][^ a-zà-ü]|[¡-ÿ]{4,}|鈥|锛|銆|茅|[\u0080-\u009f]")
_NO_CORPUS = PairTable(np.zeros(1, np.uint16), 1e9)

FEATURES = [
    "known", "known_first", "words", "link_density", "parts", "words_per_part", "odds", "heading", "bullet", "row", "quote", "code", "ends_sentence", "site_links", "web_links", "year", "related",
    "since_related", "lines", "block_words", "block_links", "block_known", "block_odds", "before_words", "before_known", "before_odds", "after_words", "after_known", "after_odds", "prev_known", "next_known",
    "prev_words", "next_words", "place", "from_end", "after_title", "after_source", "page_known", "page_words",
]


def count_words(text: str) -> float:
    """Words; two Chinese characters count as one."""
    return _measured(text)[1]


def _measured(text: str) -> tuple[list[str], float]:
    """Words of a text, of Chinese runs each two neighbouring characters, and how many words it has."""
    words = _WORD.findall(text.casefold())
    if text.isascii() or not (cjk := len(_CJK.findall(text))):
        return words, float(len(words))
    out = []
    for w in words:
        if w.isascii() or not _CJK.search(w):
            out.append(w)
        else:
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
    return out, cjk / 2 + len(_WORD.findall(_CJK.sub(" ", text)))


def plain(part: str) -> str:
    """A part of a line as it is compared: digits as 0, without marks around it."""
    return _DIGITS.sub("0", part).strip(" *:：[]").casefold()


def tokens(text: str) -> list[str]:
    return _measured(text)[0]


class Wording(NamedTuple):
    """What is known of the wording of furniture; empty for a site that words it otherwise."""

    kinds: dict[str, set[str]]
    odds: dict[str, float]
    related: frozenset[str]
    sources: frozenset[str]
    sites: tuple[str, ...]


NO_WORDING = Wording({}, {}, frozenset(), frozenset(), ())
TITLE_FEATURES = ["equal", "contains", "none_own", "lost_own", "counter", "path", "parts", "known_part", "site_part", "foot_part", "extra_words"]


class PageModel:
    """What the labelled table teaches: the wording of furniture, and a tree for lines and one for titles."""

    def __init__(self, pages: int = TRAINING_PAGES) -> None:
        phrases = L.furniture_phrases()
        kinds: dict[str, set[str]] = {}
        for kind, own in phrases.items():
            for p in sorted(own):
                for part in [p, *_PARTS.split(p)]:
                    kinds.setdefault(plain(part), set()).add(kind)
        labelled = L.training_pages(pages)
        sites = L.SITE_WORDS.split("|")
        whole = Wording(kinds, self._word_odds(labelled), frozenset(plain(p) for p in phrases["related"]), frozenset(plain(w) for a in L.ARTICLE.values() for w in a["sources"].split("|")), tuple(w.casefold() for w in sites))
        x, y = [], []
        rng = random.Random(11)
        for k, page in enumerate(labelled):
            self.wording = [whole, NO_WORDING, whole._replace(kinds={p: kinds[p] for p in sorted(kinds) if rng.random() > HIDDEN})][k % 3]
            self._line = self._judge_line
            f, at = self.features([t for t, _ in page])
            x.append(f)
            y += [page[i][1] for i in at]
        self.tree = DecisionTree(depth=12, leaf=30).fit(np.concatenate(x), np.array(y))
        self.use(whole)
        titles = L.training_titles(pages)
        self.titles = DecisionTree(depth=6, leaf=10).fit(np.array([self.title_features(*t) for t, _ in titles]), np.array([more for _, more in titles]))

    def use(self, wording: Wording) -> None:
        self.wording, self._line = wording, lru_cache(maxsize=40_000)(self._judge_line)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_line"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._line = lru_cache(maxsize=40_000)(self._judge_line)

    def _word_odds(self, labelled: list[list[tuple[str, int]]]) -> dict[str, float]:
        # Furniture speaks through its own phrases; titles in its lists of other pages are not its words.
        count, n = [Counter(), Counter()], [1.0, 1.0]
        for phrase in (p for own in L.furniture_phrases().values() for p in own):
            count[1].update(set(tokens(phrase)))
            n[1] += 1
        for text, label in (x for page in labelled for x in page):
            if label == 0:
                count[0].update(set(tokens(_LINK.sub(r"\1", text)[:300])))
                n[0] += 1
        odds = {w: math.log((count[1][w] + 0.5) / n[1]) - math.log((count[0][w] + 0.5) / n[0]) for w in count[1]}
        # Only what speaks for furniture counts: articles are about anything, and words never seen must not speak either way.
        return {w: v for w, v in odds.items() if v > 0}

    def _judge_line(self, text: str) -> tuple[float, ...]:
        """Features of a line by itself, and whether it heads a list of other pages or of sources."""
        linked_here = "](" in text
        links = _LINK.findall(text) if linked_here else []
        bare = _LINK.sub(r"\1", text) if linked_here else text
        body = _MARK.sub("", bare)
        buttons = _BUTTON.findall(body) if "[" in body else []
        parts = [p for p in (plain(p) for p in (buttons if buttons and len(buttons) > 1 else _PARTS.split(body.strip("| ")))) if p]
        whole = plain(body)
        has = self.wording
        hits = [p in has.kinds or p.endswith(has.sites) for p in parts]
        known = 1.0 if whole in has.kinds else (sum(hits) / len(hits) if hits else 0.0)
        colon = _COLON.match(body)
        lead = plain(colon.group(1)) if colon else ""
        kinds = has.kinds.get(lead, set())
        if colon and kinds & {"tags", "read", "related", "end"}:
            known = 1.0
        first = 1.0 if hits and hits[0] else 0.0
        toks, n = _measured(body)
        odds_of = has.odds.get
        odds = sum([odds_of(t, 0.0) for t in toks]) / len(toks) if toks else 0.0
        if text.lstrip().startswith("#"):
            known = float(whole in has.related)  # an article may have a section on the site's plan
            odds = odds if known else 0.0
        if not toks and re.fullmatch(r"[\s|:\-]+", text):
            known = -1.0  # the rule of a table: judged by its rows
        linked = sum(len(a) for a, _ in links)
        density = min(1.0, linked / max(1, len(body.strip()))) if links else 0.0
        inner = sum(not re.match(r"[a-z]+:", u) for _, u in links)
        s = text.lstrip()
        return (
            known, first, n, density, float(len(parts)), n / max(1, len(parts)), odds, float(s.startswith("#")), float(bool(re.match(r"[-*+]\s|\d+[.)]\s", s))), float(s.startswith("|")), float(s.startswith(">")), 0.0,
            float(bool(_END.search(body))), float(inner), float(len(links) - inner), float(bool(_YEAR.search(body)) and n < 12),
            float(whole in has.related or lead in has.related and body.strip().endswith((":", "："))), float(s.startswith("#") and whole in has.sources),
        )

    def features(self, lines: list[str]) -> tuple[np.ndarray, list[int]]:
        """Features of all lines that are not blank, and their places."""
        at = [i for i, t in enumerate(lines) if t.strip()]
        if not at:
            return np.zeros((0, len(FEATURES))), at
        own = np.array([self._line(lines[i].strip("\r")) for i in at], np.float64)
        n = len(at)
        marks, heads = own[:, 16], own[:, 17]
        own = own[:, :16]
        fenced, inside = np.zeros(n), False
        for k, i in enumerate(at):
            fence = lines[i].lstrip().startswith(("```", "~~~"))
            fenced[k] = inside or fence
            inside ^= fence
        own[:, 11] = fenced
        block = np.cumsum([0, *[int(b - a > 1) for a, b in zip(at, at[1:])]])
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.append(starts, n)).astype(float)
        rule = own[:, 0] < 0
        own[rule, 0] = 0.0
        counted = np.maximum(1.0, np.add.reduceat((~rule).astype(float), starts))
        mean = lambda c: np.add.reduceat(np.where(rule, 0.0, own[:, c]), starts) / counted
        b_words, b_links, b_known, b_odds = mean(2), mean(3), mean(0), mean(6)
        own[rule, 0] = b_known[block[rule]]

        def beside(v: np.ndarray, step: int) -> np.ndarray:
            out = np.zeros(len(v))
            if step > 0:
                out[:-1] = v[1:]
            else:
                out[1:] = v[:-1]
            return out[block]

        def line_beside(c: int, step: int) -> np.ndarray:
            out = np.zeros(n)
            if step > 0:
                out[:-1] = own[1:, c]
            else:
                out[1:] = own[:-1, c]
            return out

        related, since, source, live, blocks_on, src = np.zeros(n), np.full(n, 99.0), np.zeros(n), 0, 0, 0
        for k in range(n):
            new = k == 0 or block[k] != block[k - 1]
            if marks[k]:
                live, head, blocks_on, src = 1, k, block[k], 0
            elif live and new and (block[k] > blocks_on + 1 or not (own[k, 8] or own[k, 3] > 0.5)):
                live = 0
            if heads[k]:
                src, live = 1, 0
            elif src and new and not own[k, 8]:
                src = 0
            related[k], source[k] = live, src
            if live:
                since[k] = k - head
        # A block under the name of a list of other pages is known by it.
        b_known = np.maximum(b_known, np.maximum.reduceat(related, starts))
        top = np.cumsum([lines[i].startswith("# ") for i in at]) > 0
        place = np.arange(n) / max(1, n - 1)
        page = np.ones(n)
        f = np.column_stack(
            [own, related, since, size[block], b_words[block], b_links[block], b_known[block], b_odds[block], beside(b_words, -1), beside(b_known, -1), beside(b_odds, -1), beside(b_words, 1), beside(b_known, 1),
             beside(b_odds, 1), line_beside(0, -1), line_beside(0, 1), line_beside(2, -1), line_beside(2, 1), np.minimum(np.arange(n), 40.0), np.minimum(n - 1.0 - np.arange(n), 40.0), top.astype(float), source,
             page * own[:, 0].mean(), page * np.median(own[:, 2])]
        )
        return f, at

    def furniture(self, text: str) -> tuple[list[int], list[str]]:
        """Numbers (from 1) of the furniture lines, and all lines as they were judged."""
        lines = [repair(t, _NO_CORPUS)[1] or t if _STRANGE.search(t) else t for t in text.split("\n")]
        f, at = self.features(lines)
        if not at:
            return [], lines
        hit = self.tree.predict(f) >= CUT
        return [i + 1 for i, h in zip(at, hit) if h], lines

    def own_title(self, lines: list[str], furniture: list[int]) -> str | None:
        bad = set(furniture)
        for i, t in enumerate(lines):
            if t.startswith("# ") and i + 1 not in bad:
                return t[2:].strip()
        return None

    def title_features(self, title: str, own: str | None, feet: list[str]) -> list[float]:
        """How a captured title compares with the page's own (if there is one), and what its parts and the page's furniture say."""
        squeeze = lambda t: " ".join(t.casefold().split())
        t, o = squeeze(title), squeeze(own) if own and "�" not in own else ""
        pieces = [p.strip() for p in _TITLE_PARTS.split(title.strip())]
        lead = _TITLE_LEAD.match(title.strip())
        beside = pieces[1:] + ([lead.group(1).strip()] if lead else [])
        known = any(plain(p) in self.wording.kinds for p in [*beside, pieces[0]][: len(beside) + (len(pieces) > 1)])
        site = any(p.casefold().endswith(self.wording.sites) for p in beside) if self.wording.sites else False
        foot = any(len(p) >= 3 and p in x for p in beside for x in feet)
        extra = count_words(t.replace(o, " ", 1)) if o and o in t else 0.0
        return [float(bool(o) and t == o), float(bool(o) and o in t), float(not o), float(bool(o) and o not in t), float(bool(re.match(r"\(\d+\)\s+\S", title.strip()))), float(" » " in title), float(len(pieces)), float(known), float(site), float(foot), extra]

    def feet(self, lines: list[str], furniture: list[int]) -> list[str]:
        """Furniture lines with a year or a copyright mark, which name the site."""
        return [lines[i - 1] for i in furniture if _FOOT.search(lines[i - 1])]

    def title_holds_more(self, title: str, own: str | None, feet: list[str]) -> bool:
        """Whether a captured title has more than the own title of its page."""
        if not title.strip():
            return False
        return bool(self.titles.predict(np.array([self.title_features(title, own, feet)]))[0] >= 0.5)


_MODEL: list[PageModel] = []


def model() -> PageModel:
    """The model, trained once on the driver; its size depends on the labelled table alone."""
    if not _MODEL:
        _MODEL.append(PageModel())
    return _MODEL[0]


def furniture_lines(pages: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """``conv_id, line_no`` of furniture of ``conv_id, markdown``; line 0 if some title of ``captures`` (``conv_id, title``) holds more than the own one.

    Texts are not shuffled: titles meet what a page says of its own title.
    """
    held = pages.sparkSession.sparkContext.broadcast(model())

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            ids, numbers, owns, feet = [], [], [], []
            for i, text in zip(*[c.to_pylist() for c in b.columns]):
                bad, lines = m.furniture(text or "")
                ids += [i] * (len(bad) + 1)
                numbers += [0, *bad]
                owns += [m.own_title(lines, bad)] + [None] * len(bad)
                feet += [m.feet(lines, bad)] + [None] * len(bad)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(owns, pa.string()), pa.array(feet, pa.list_(pa.string()))], ["conv_id", "line_no", "own", "feet"])

    found = pages.select("conv_id", "markdown").mapInArrow(lines_of, "conv_id long, line_no int, own string, feet array<string>")
    if captures is None:
        return found.where("line_no > 0").select("conv_id", "line_no")
    found = write_once(found, "furniture")

    def titles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            more = [m.title_holds_more(t, own, feet or []) for t, own, feet in zip(*[c.to_pylist() for c in b.columns[1:]])]
            ids = b.column(0).filter(pa.array(more, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(len(ids), np.int32))], ["conv_id", "line_no"])

    titles = captures.where("conv_id is not null and title is not null").select("conv_id", "title").distinct()
    met = merged(found.where("line_no = 0").distinct(), titles, "conv_id").select("conv_id", "title", "own", "feet")
    return found.where("line_no > 0").select("conv_id", "line_no").unionByName(met.mapInArrow(titles_of, "conv_id long, line_no int"))


def main_content(pages: DataFrame) -> DataFrame:
    """``conv_id, content`` of ``conv_id, markdown``: the article's own lines, blank lines next to each other as one."""

    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                bad = set(m.furniture(text)[0])
                kept = "\n".join(t for i, t in enumerate(text.split("\n"), 1) if i not in bad)
                out.append(re.sub(r"\n(?:[ \t\r]*\n){2,}", "\n\n", kept).strip("\r\n"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["conv_id", "content"])

    return pages.select("conv_id", "markdown").mapInArrow(run, "conv_id long, content string")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Web pages converted without error; equal rows are judged alike and give equal lines."""
    return table(spark, d, "conversion_results").where("kind = 'html' and ok and markdown <> ''").select("conv_id", "markdown")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Furniture lines of every page, and line 0 for captured titles with more than the page's own."""
    return furniture_lines(_pages(spark, d), table(spark, d, "capture_results")).distinct()


def p2_content(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every page."""
    return main_content(_pages(spark, d)).distinct()


QUERIES = {"p2_found": p2_found, "p2_content": p2_content}
SQL: dict[str, str] = {}
