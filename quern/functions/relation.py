"""Relations that a question asks about and their evidence, in plain Python.

A question is matched against an ordered table of forms; the first that fits says
whether the relation is checked and names anchor and target. Evidence is looked for
in the units of the retrieved blocks, in a fixed order of strength.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quern.functions.markdown import evidence_units

# The forms of questions in the order in which they are tried, with the kind of relation and whether it is checked;
# questions that are let pass; names behind or before words of responsibility, in the order in which they are tried; names
# before and behind verbs of cause; names of entities.
FORMS = [
    ("event", True, r"^(?:哪个|什么)(?:天气)?(?:过程|事件|原因|因素)(?:导致|造成|引起|引发|致使)(?P<t>.+?)[？?]?$"),
    ("event", True, r"^(?P<t>.+?)(?:是)?(?:由|因为|由于)(?:哪个|什么)(?:天气)?(?:过程|事件|原因|因素)(?:导致|造成|引起|引发|致使)的?[？?]?$"),
    ("causal", True, r"^(?P<a>.+?)是否(?:会)?(?:导致|造成|引起|引发|致使)(?P<t>.+?)[？?]?$"),
    ("causal", True, r"^(?P<t>.+?)是否(?:是)?由(?P<a>.+?)(?:导致|造成|引起|引发|致使)[？?]?$"),
    ("causal", True, r"^(?P<a>.+?)(?:导致|造成|引起|引发|致使)(?:了)?(?:哪些|什么)(?:后果|结果|问题|危害|事故)[？?]?$"),
    ("responsibility", True, r"^(?P<a>.+?)(?:是否|是)?由谁(?:来)?负责[？?]?$"),
    ("responsibility", True, r"^(?P<a>.+?)由哪(?:个|些)(?:部门|单位|人员|岗位)负责[？?]?$"),
    ("responsibility", True, r"^(?P<a>.+?)(?:是)?谁负责的[？?]?$"),
    ("responsibility", True, r"^谁负责(?P<a>.+?)[？?]?$"),
    ("responsibility", True, r"^(?P<a>.+?)(?:是否|是)?由(?P<t>.+?)负责[？?]?$"),
    ("property", False, r"^(?P<a>.+?)的(?P<t>.+?)是(?P<v>.+?)吗[？?]?$"),
    ("property", False, r"^(?P<a>.+?)的(?P<t>[^的]{2,8}?)(?:是多少|是什么|是谁|是什么型号)?[？?]?$"),
    ("impact", False, r"^(?P<a>.+?)(?:造成了|造成|带来|产生了|产生)?(?:哪些|什么)?影响[？?]?$"),
]
PASS = [r"职责", r"负责[^？?]{0,6}(?:工作|工作内容|事项)"]
OWNERS = [
    r"责任单位[：:]\s*([一-龥A-Za-z0-9\-－]{2,14})",
    r"责任人为\s*([一-龥A-Za-z0-9\-－]{2,14})",
    r"责任单位为\s*([一-龥A-Za-z0-9\-－]{2,14})",
    r"负责人[：:]\s*([一-龥A-Za-z0-9\-－]{2,14})",
    r"负责人为\s*([一-龥A-Za-z0-9\-－]{2,14})",
    r"由([一-龥A-Za-z0-9\-－]{2,14}?)负责",
    r"([一-龥A-Za-z0-9\-－]{2,14})[，,]\s*负责",
    r"([一-龥A-Za-z0-9\-－]{2,14})负责",
]
CAUSED = r"([一-龥A-Za-z0-9\-－]{2,14}?)(?:导致|造成|引起|引发|致使)"
CAUSED_BY = r"由([一-龥A-Za-z0-9\-－]{2,14}?)(?:导致|造成|引起|引发|致使)"
ENTITY = r"[A-Z]{1,6}[-－]\d{1,4}"

_COMPILED = [(kind, guard, re.compile(p)) for kind, guard, p in FORMS]
_SUBJECT = re.compile(CAUSED)


@dataclass(frozen=True)
class Relation:
    guarded: bool
    kind: str = ""
    anchor: str = ""
    target: str = ""


@dataclass(frozen=True)
class Verdict:
    verdict: str
    rule: str
    owner: str = ""
    unit: str = ""
    parent_id: str = ""


def analyze_relation(query: str | None) -> Relation:
    q = (query or "").strip()
    if not q or any(re.search(p, q) for p in PASS):
        return Relation(False)
    for kind, guard, form in _COMPILED:
        m = form.match(q)
        if m:
            g = m.groupdict()
            return Relation(guard, kind, (g.get("a") or "").strip(), (g.get("t") or "").strip())
    return Relation(False)


def owner_in(text: str) -> str:
    """Who is responsible, by the first pattern that fits."""
    return next((m[1] for p in OWNERS if (m := re.search(p, text))), "")


def subjects_in(text: str) -> set[str]:
    """Names the text itself gives as causes or as responsible."""
    found = {m[1] for m in _SUBJECT.finditer(text)} | {m[1] for m in re.finditer(CAUSED_BY, text)}
    found |= {m[1] for p in OWNERS[:-1] if (m := re.search(p, text))}
    return {x for x in found if len(x) >= 2}


def evaluate(r: Relation, parents: list[tuple[str, str, str]]) -> Verdict:
    """Judge a relation by blocks (``parent_id, section_path, content``) in the order of their ranks."""
    if not r.guarded:
        return Verdict("YES", "not checked")
    units = [(pid, section or "", text) for pid, section, content in parents for text, _, _ in evidence_units(content or "")]
    a, t = r.anchor, r.target
    with_anchor = [u for u in units if a and a in u[2]]
    with_target = [u for u in units if t and t in u[2]]
    if r.kind == "event":
        for pid, _, text in with_target:
            m = _SUBJECT.search(text)
            if m:
                return Verdict("YES", "cause named", m[1], text, pid)
        return Verdict("INSUFFICIENT", "no cause named")
    if r.kind == "responsibility":
        for pid, _, text in with_anchor:
            owner = owner_in(text)
            if owner:
                return Verdict("NO" if t and owner != t else "YES", "owner named", owner, text, pid)
    if a and t:
        for pid, _, text in with_anchor:
            if t in text:
                return Verdict("YES", "same unit", "", text, pid)
        for pid, section, text in with_target:
            if a in section:
                return Verdict("YES", "in the anchor's section", "", text, pid)
    names = sorted(set().union(*(subjects_in(c or "") for _, _, c in parents))) if parents else []
    for pid, _, text in with_target if a else []:
        other = next((w for w in names if w in text and w not in a and a not in w), "")
        if other:
            return Verdict("NO", "another name", other, text, pid)
        entities = set(re.findall(ENTITY, text))
        if entities and a not in entities:
            return Verdict("NO", "another entity", min(entities), text, pid)
    return Verdict("INSUFFICIENT", "found apart" if with_anchor or with_target else "not found")


def blocked_message(r: Relation, v: Verdict) -> str:
    """What is said instead of an answer when the relation does not hold."""
    if v.verdict == "NO":
        return f"资料显示与「{r.target or r.anchor}」相关的是「{v.owner}」，而不是「{r.anchor if r.target else r.target}」。"
    return f"资料中没有找到「{r.anchor}」与「{r.target}」之间的直接关系。" if r.anchor and r.target else f"资料中没有找到关于「{r.anchor or r.target}」的直接证据。"
