"""The analysis of questions as SQL text, which the queries on questions are checked against."""

from __future__ import annotations

from quern.functions import query as Q

_CJK = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _usable(t: str) -> str:
    return f"({t} <> '' and not list_contains({_list(Q.STOPWORDS)}, lower({t})))"


def _distinct(a: str) -> str:
    return f"list_filter({a}, lambda v, i: list_position({a}, v) = i)"


def parts_sql(t: str) -> str:
    """Terms of a token."""
    behind = "case when s <> w and ends_with(s, w) then left(s, length(s) - length(w)) else s end"
    both = f"case when ({behind}) <> w and starts_with(({behind}), w) then right(({behind}), length(({behind})) - length(w)) else ({behind}) end"
    core = f"list_reduce(list_concat([{t}], {_list(Q.EDGES * Q.ROUNDS)}), lambda s, w: {both})"
    return f"list_filter(case when regexp_full_match({t}, '[{_CJK}]+') then regexp_split_to_array({core}, '[{Q.PARTS}]') else [{t}] end, lambda p: {_usable('p')})"


def tokens_sql(q: str) -> str:
    return f"regexp_extract_all(coalesce({q}, ''), '[A-Za-z0-9_+#.]+|[{_CJK}]+')"


def terms_sql(q: str) -> str:
    """Content terms of a question."""
    return f"flatten(list_transform({tokens_sql(q)}, lambda t: {parts_sql('t')}))"


def analyzed_sql(q: str) -> str:
    """Runs of a question with their kind."""
    bare = f"case when regexp_matches(t, '{Q.TAIL}') then trim(regexp_replace(t, '{Q.TAIL}', ''), '的了 ') else t end"
    marked = " or ".join(f"(starts_with(t, '{p}') and length(t) > {len(p) + 1})" for p in Q.SCOPE_BEFORE)
    head = "left(b, length(b) - 1)"
    within = f"length(b) >= 3 and list_contains({_list(Q.SCOPE_AFTER)}, right(b, 1)) and regexp_full_match(b, '[{_CJK}]+') and {_usable(head)} and not ends_with({head}, '哪')"
    of_bare = f"list_transform([{bare}], lambda b: case when {within} then {{'kind': 'S', 'run': {head}}} else {{'kind': 'T', 'run': b}} end)[1]"
    return f"list_filter(list_transform({tokens_sql(q)}, lambda t: case when {marked} then {{'kind': 'S', 'run': substring(t, 3)}} else {of_bare} end), lambda x: x.run <> '')"


def marks_sql(terms: str, tokens: str) -> str:
    """Terms to highlight, the longest first."""
    base = f"(case when len({terms}) > 0 then {terms} else {tokens} end)"
    bare = f"list_filter(list_transform({base}, lambda t: regexp_replace(trim(t), '^[{Q.ASKING}]+|[{Q.ASKING}]+$', '', 'g')), lambda t: length(t) >= 2)"
    kept = f"(case when len({bare}) > 0 then {bare} else list_filter({base}, lambda t: length(t) >= 2) end)"
    return f"list_transform(list_sort(list_transform({_distinct(kept)}, lambda t, i: {{'l': -length(t), 'i': i, 't': t}})), lambda x: x.t)[1:{Q.HIGHLIGHTS}]"


def units_sql(blocks: str) -> str:
    """Tables ``u`` of the evidence units (``parent_id, no, kind, text``) of blocks (``parent_id, content``), to be put before a select."""
    marks = "[-\u2022*\t \u3000]"
    return f"""b as ({blocks}), l0 as (select parent_id, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') l from b), l1 as (select parent_id, unnest(l) line, generate_subscripts(l, 1) no from l0),
 l2 as (select *, regexp_replace(line, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g') s from l1), l3 as (select *, length(s) > 2 and s[1] = '|' and s[-1] = '|' tab from l2 where not regexp_full_match(s, '[|: -]*')),
 l4 as (select *, tab and not coalesce(lag(tab) over (partition by parent_id order by no), false) head from l3), l5 as (select *, last_value(case when head then line end ignore nulls) over (partition by parent_id order by no rows unbounded preceding) h from l4),
 n0 as (select parent_id, no, regexp_replace(regexp_replace(line, '^{marks}+', ''), '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g') body from l5 where not tab), n1 as (select *, list_filter(list_transform(regexp_split_to_array(body, '[。！？；;]'), lambda v: regexp_replace(v, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g')), lambda v: v <> '') p from n0),
 u as (select parent_id, no, case when head then 'table_header' else 'table_row' end kind, case when head then line else h || ' ' || line end as text from l5 where tab union all select parent_id, no, 'sentence', unnest(p) from n1 where len(p) > 1 union all select parent_id, no, 'line', body from n1 where len(p) <= 1)"""
