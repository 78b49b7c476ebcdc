"""How well a block fits a question: occurrences of its terms by rarity, headings, phrases, and signs of the answer's kind.

One object holds what follows from the question alone, so that blocks of one question
are judged with patterns made once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

# Weights of the signs of relevance, and the length of a short block.
WHOLE, HEADING, PAIR, SHORT, TABLE, SHORT_CHARS = 6.0, 4.0, 3.0, 2.0, 1.0, 120
# Signs of an answer by the kind of question, with their bonus.
PERSON = [(r"(负责人|责任人|姓名|联系人|职称)", 1.2), (r"\|\s*[^|\n]{1,8}\s*\|\s*[一-鿿]{2,4}\s*\|", 0.8)]
DATETIME = [(r"(\d+\s*(天|日|周|月|年|小时|分钟|次|遍|期))|(每天|每日|每周|每月|每季|每年|每隔|每\s*\d)", 1.2)]
LOCATION = [(r"(位于|位置|点号|编号|标号)", 0.6)]
MODEL_CODE, MODEL_SECTION, MODEL_QUALITY = r"[A-Za-z]{2,5}[- ]?\d{1,4}[A-Za-z]?", r"(设备|规格|型号|仪器|材料)", r"(精度|等级|检定|有效期|有效期至|合格|校准|误差|读数)"
MODEL_BONUS = {"entity and code": 2.5, "code in section": 1.2, "entity": 0.4, "quality": -0.8}
MODEL_EMPTY = ["的", "了", "吗", "呢", "是什么", "是什么型号", "型号", "规格", "什么", "哪些", "有", "在", "是", "如何", "怎么样", "介绍", "总结", "功能", "特点", "用途", "情况", "内容", "信息", "能力", "特性", "支持", "包含", "包括", "要求", "规定", "安排", "主要", "核心", "相关", "具体"]
DIGIT_BONUS, DIGIT_BEFORE, DIGIT_BEHIND = 8.0, 12, 14

_CODE, _SECTION, _QUALITY = re.compile(MODEL_CODE), re.compile(MODEL_SECTION), re.compile(MODEL_QUALITY)
_BY_KIND = {kind: [(re.compile(p), bonus) for p, bonus in signs] for kind, signs in (("person", PERSON), ("datetime", DATETIME), ("location", LOCATION))}
_HEADING_LINES = re.compile(r"(?m)^[^\S\n]*#.*$")


class Block:
    """A block's content and section path, with what many questions ask of them."""

    def __init__(self, content: str, section: str) -> None:
        self.content, self.section = content, section
        self.low = content.lower()
        self._counts: dict[str, int] = {}
        self._signs: dict[str, float] = {}

    def count(self, term: str) -> int:
        """How often a term stands in the content."""
        n = self._counts.get(term)
        if n is None:
            n = self._counts[term] = self.low.count(term)
        return n

    @cached_property
    def headings(self) -> list[str]:
        return _HEADING_LINES.findall(self.low) if "#" in self.low else []

    @cached_property
    def low_section(self) -> str:
        return self.section.lower()

    @cached_property
    def code(self) -> bool:
        return bool(_CODE.search(self.content))

    @cached_property
    def quality(self) -> bool:
        return bool(_QUALITY.search(self.content))

    def sign(self, kind: str) -> float:
        """The bonus for a kind of question whose signs don't depend on the question."""
        if kind not in self._signs:
            whole = self.content if kind == "location" else f"{self.section}\n{self.content}"
            self._signs[kind] = next((b for p, b in _BY_KIND.get(kind, ()) if p.search(whole)), 0.0)
        return self._signs[kind]


class Asked:
    """A question with its terms, their weights (in the same order) and its target terms."""

    def __init__(self, query: str | None, kind: str, terms: Sequence[str], weights: Sequence[float], target: Sequence[str]) -> None:
        self.kind = kind
        self.query = (query or "").lower()
        self.terms = [(t.lower(), w) for t, w in zip(terms, weights)]
        self.whole = WHOLE * dict(zip(terms, weights)).get((query or "")[:2], 1.0)
        self.pairs = [(a + b).lower() for a, b in zip(terms, terms[1:])]
        self.target = list(target)
        self.entities = [t for t in target if len(t) >= 2 and t not in MODEL_EMPTY]

    @cached_property
    def digit(self) -> re.Pattern:
        """A digit before or behind a target term, or within it."""
        any_target = "|".join(map(re.escape, sorted(self.target, key=len, reverse=True)))
        return re.compile(rf"(?s)\d.{{0,{DIGIT_BEFORE - 1}}}(?:{any_target})|(?:{any_target}).{{0,{DIGIT_BEHIND - 1}}}\d")

    def heaviest(self, text: str) -> float:
        """The weight of the heaviest term in a text."""
        return max((w for t, w in self.terms if t in text), default=0.0)

    def relevance(self, content: str, section: str) -> float:
        """Weighted occurrences, and bonuses for the whole question, headings, neighbouring terms, short blocks and tables."""
        return self._relevance(Block(content, section))

    def bonus(self, content: str, section: str) -> float:
        """For blocks that can hold the kind of answer asked for; nothing for questions without a target."""
        return self._bonus(Block(content, section))

    def score(self, block: Block) -> float:
        """Relevance and bonus."""
        return self._relevance(block) + self._bonus(block)

    def _relevance(self, block: Block) -> float:
        content, low = block.content, block.low
        if not content and not block.section:
            return 0.0
        counts = [block.count(t) for t, _ in self.terms]
        signs = [
            self.whole if self.query and self.query in low else 0.0,
            sum(n * w for n, (_, w) in zip(counts, self.terms)),
            HEADING * sum(map(self.heaviest, block.headings)) if block.headings else 0.0,
            HEADING * self.heaviest(block.low_section),
            PAIR * sum(block.count(p) > 0 for p in self.pairs),
            SHORT if len(content) <= SHORT_CHARS and all(counts) else 0.0,
            TABLE if "|" in content and any(counts) else 0.0,
        ]
        return float(sum(signs))

    def _bonus(self, block: Block) -> float:
        if not self.target:
            return 0.0
        if self.kind == "quantity":
            return DIGIT_BONUS if self.digit.search(block.content) else 0.0
        if self.kind == "model":
            return MODEL_BONUS.get(self._model_sign(block), 0.0)
        return block.sign(self.kind)

    def _model_sign(self, block: Block) -> str:
        code, entity = block.code, any(t in block.content for t in self.entities)
        signs = {"entity and code": code and entity, "code in section": code and bool(_SECTION.search(block.section)), "entity": entity, "quality": block.quality}
        return next((name for name, holds in signs.items() if holds), "")
