"""CSS selectors over the flat tree of a page (H09), as array expressions.

A selector becomes a chain of marks, one boolean for each element by its number. The marks of a step are read by the next
one: a child looks at its parent's mark, a sibling at the mark of the sibling before, and a descendant at whether its
number lies between `no` and `end` of a marked element. Of marked elements inside one another only the outermost
intervals count, which do not overlap, so each step takes time in proportion to the page.

Known are tags, `*`, `.class`, `#id`, `[attr]` with `=`, `~=`, `|=`, `^=`, `$=` and `*=`, `:first-child`, the combinators
` `, `>` and `+`, and lists with commas. Attributes beyond the usual ones are there if `parse_pages` was told to keep them.
"""

from __future__ import annotations

import re

_NAME = r"-?[_a-zA-Z\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_SIMPLE = re.compile(
    rf"""(?P<tag>{_NAME}|\*)|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|(?P<first>:first-child)
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|{_NAME}|\d+)\s*)?\]""",
    re.VERBOSE,
)
_COMBINATOR = re.compile(r"\s*([>+])\s*|\s+")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _attribute_test(name: str, op: str | None, value: str) -> str:
    held = f"e.attrs['{name.lower()}']"
    if op is None:
        return f"{held} IS NOT NULL"
    v = _quoted(value)
    tests = {
        "=": f"{held} = {v}", "~=": rf"array_contains(split({held}, '\\s+'), {v})", "|=": f"({held} = {v} OR startswith({held}, {_quoted(value + '-')}))",
        "^=": f"startswith({held}, {v})", "$=": f"endswith({held}, {v})", "*=": f"contains({held}, {v})",
    }
    # An empty text is part of every text, yet selects nothing.
    return f"coalesce({tests[op]}, false)" if value or op in ("=", "|=") else "false"


def _compound(text: str, at: int) -> tuple[str, int]:
    """SQL of the tests that begin at a place of the selector, and the place after them."""
    tests, start = [], at
    while found := _SIMPLE.match(text, at):
        if found["tag"]:
            if at > start:
                break
            tests += [] if found["tag"] == "*" else [f"e.tag = {_quoted(found['tag'].lower())}"]
        elif found["cls"]:
            tests.append(_attribute_test("class", "~=", found["cls"]))
        elif found["id"]:
            tests.append(_attribute_test("id", "=", found["id"]))
        elif found["first"]:
            tests.append("e.prev = -1")
        else:
            value = found["value"] or ""
            tests.append(_attribute_test(found["attr"], found["op"], value[1:-1] if value[:1] in ("'", '"') else value))
        at = found.end()
    if at == start:
        raise ValueError(f"unsupported selector: {text}")
    return " AND ".join(tests) or "true", at


def parsed(selector: str) -> list[list[tuple[str, str]]]:
    """For each selector of the list its steps: the combinator before the step ('' for the first) and the step's test."""
    lists, at, text = [[]], 0, selector.strip()
    while at < len(text):
        before = ""
        if lists[-1]:
            if comma := re.compile(r"\s*,\s*").match(text, at):
                lists.append([])
                at = comma.end()
            elif found := _COMBINATOR.match(text, at):
                before, at = found[1] or " ", found.end()
            else:
                raise ValueError(f"unsupported selector: {selector}")
        test, at = _compound(text, at)
        lists[-1].append((before, test))
    if not lists[-1]:
        raise ValueError(f"unsupported selector: {selector}")
    return lists


def _inside(elements: str, marks: str) -> str:
    """Marks of the elements that lie inside a marked one."""
    # Outermost marked elements, each with the end of the one before.
    outer = (
        f"aggregate(filter({elements}, f -> get({marks}, f.no)), "
        "named_struct('last', 0, 'spans', cast(array() AS array<struct<gap:int,no:int,end:int>>)), "
        "(acc, f) -> CASE WHEN f.no < acc.last THEN acc ELSE named_struct('last', f.end, "
        "'spans', array_append(acc.spans, named_struct('gap', acc.last, 'no', f.no, 'end', f.end))) END)"
    )
    runs = "transform(o.spans, s -> concat(array_repeat(false, s.no + 1 - s.gap), array_repeat(true, s.end - s.no - 1)))"
    return f"get(transform(array({outer}), o -> concat(flatten({runs}), array_repeat(false, size({elements}) - o.last))), 0)"


def _marks(steps: list[tuple[str, str]], elements: str) -> str:
    """SQL of the marks of a selector without commas."""
    marks = f"transform({elements}, e -> {steps[0][1]})"
    for k, (before, test) in enumerate(steps[1:]):
        m = f"m{k}"
        if before == " ":
            near = f"get(transform(array({_inside(elements, m)}), i{k} -> transform({elements}, e -> get(i{k}, e.no) AND {test})), 0)"
        else:
            other = "e.parent" if before == ">" else "e.prev"
            near = f"transform({elements}, e -> {other} >= 0 AND coalesce(get({m}, {other}), false) AND {test})"
        # The marks before are a lambda variable, so they are computed once.
        marks = f"get(transform(array({marks}), {m} -> {near}), 0)"
    return marks


def first_selected_sql(selector: str, elements: str) -> str:
    """SQL of the first element, in document order, that a selector of the list matches; NULL without one."""
    firsts = []
    for steps in parsed(selector):
        if len(steps) == 1:
            firsts.append(f"get(filter({elements}, e -> {steps[0][1]}), 0)")
        else:
            firsts.append(f"get(transform(array({_marks(steps, elements)}), m -> get(filter({elements}, e -> get(m, e.no)), 0)), 0)")
    return firsts[0] if len(firsts) == 1 else f"get(array_sort(filter(array({', '.join(firsts)}), r -> r IS NOT NULL), (a, b) -> a.no - b.no), 0)"
