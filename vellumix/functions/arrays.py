"""Ordered rules that carry a state from line to line, as folds over arrays.

These define the rules for the SQL that checks ``ordered``, which is what operators run: a fold copies
what it has gathered at every step. The elements are first given the state's own type, which both
engines can fold.
"""

from __future__ import annotations

from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK, Dialect

STRINGS = {True: "array<string>", False: "VARCHAR[]"}
UNITS = {True: "array<struct<type:string,text:string>>", False: "STRUCT(type VARCHAR, text VARCHAR)[]"}


def _none(d: Dialect, kinds: dict) -> str:
    return f"CAST({'array()' if d is SPARK else '[]'} AS {kinds[d is SPARK]})"


def _one(d: Dialect, x: str) -> str:
    return f"array({x})" if d is SPARK else f"[{x}]"


def _both(d: Dialect, a: str, b: str) -> str:
    return f"concat({a}, {b})" if d is SPARK else f"list_concat({a}, {b})"


def _field(d: Dialect, x: str, name: str) -> str:
    return f"({x}).{name}" if d is not SPARK else f"{x}.{name}"


STANDALONE = r"^(#|([-*]|\d+\.)[WS]|!\[|\|)".replace("WS", T.WS)


def blocks(d: Dialect, text: str) -> str:
    """Markdown blocks: fences whole, headings, list items, images and table rows each alone, else runs of lines."""
    nl = "chr(10)"

    def kind(x: str) -> str:
        s = T.strip(d, x)
        return f"CASE WHEN {d.starts(s, chr(39) + '```' + chr(39))} THEN 1 WHEN {s} = '' THEN 2 WHEN {d.test(s, STANDALONE)} THEN 3 ELSE 0 END"

    none = _none(d, STRINGS)
    elements = d.map(T.lines(d, text), "e", d.struct(b=none, t="e", f="false", k=kind("e")))
    outer = lambda x: d.sub(x, r"^\n+|\n+$", "")
    flush = lambda b, x: f"CASE WHEN {outer(x)} <> '' THEN {_both(d, b, _one(d, outer(x)))} ELSE {b} END"
    done = f"CASE WHEN a.f AND v.k <> 1 THEN a.b WHEN a.f THEN {flush('a.b', f'concat(a.t, {nl}, v.t)')} WHEN v.k = 0 THEN a.b WHEN v.k = 3 THEN {_both(d, flush('a.b', 'a.t'), _one(d, 'v.t'))} ELSE {flush('a.b', 'a.t')} END"
    open_ = f"CASE WHEN a.f AND v.k <> 1 THEN concat(a.t, {nl}, v.t) WHEN a.f OR v.k IN (2, 3) THEN '' WHEN v.k = 1 OR a.t = '' THEN v.t ELSE concat(a.t, {nl}, v.t) END"
    state = d.fold(elements, d.struct(b=none, t="''", f="false", k="0"), "a", "v", d.struct(b=done, t=open_, f="CASE WHEN v.k = 1 THEN NOT a.f ELSE a.f END", k="0"))
    last = d.map(_one(d, state), "z", flush(_field(d, "z", "b"), _field(d, "z", "t")))
    return d.get(last, "0")


def chunks(d: Dialect, blocks_: str, most: int) -> str:
    """Blocks packed in order into chunks of at most ``most`` characters; headings begin one, larger blocks have one alone."""
    if most < 1:
        raise ValueError("a chunk needs room")
    none = _none(d, STRINGS)
    sep = "chr(10), chr(10)"
    elements = d.map(blocks_, "e", d.struct(c=none, t="e", n=d.length("e"), h=d.test("e", f"^[{T.WS}]*#")))
    new = f"(a.t <> '' AND (v.h OR a.n + v.n + 2 > {most}))"
    state = d.fold(
        elements,
        d.struct(c=none, t="''", n="CAST(0 AS BIGINT)", h="false"),
        "a",
        "v",
        d.struct(
            c=f"CASE WHEN {new} THEN {_both(d, 'a.c', _one(d, 'a.t'))} ELSE a.c END",
            t=f"CASE WHEN a.t = '' OR {new} THEN v.t ELSE concat(a.t, {sep}, v.t) END",
            n=f"CASE WHEN a.t = '' OR {new} THEN v.n ELSE a.n + v.n + 2 END",
            h="false",
        ),
    )
    last = d.map(_one(d, state), "z", _both(d, _field(d, "z", "c"), _one(d, _field(d, "z", "t"))))
    return d.get(last, "0")


def units(d: Dialect, text: str) -> str:
    """A page's headings, bullets and paragraphs, in order."""
    none = _none(d, UNITS)
    elements = d.map(T.lines(d, text), "e", d.struct(u=none, p=T.strip(d, "e")))
    unit = lambda kind, x: _one(d, d.struct(type=f"'{kind}'", text=x))
    flush = f"CASE WHEN a.p <> '' THEN {_both(d, 'a.u', unit('paragraph', 'a.p'))} ELSE a.u END"
    items = d.map(d.keep(d.map(d.split("v.p", "•"), "i", T.strip(d, "i")), "i", "i <> ''"), "i", d.struct(type="'bullet'", text="i"))
    last = f"{d.get('a.u', f'{d.size(chr(97) + chr(46) + chr(117))} - 1')}"
    goes_on = f"(a.p = '' AND {d.size('a.u')} > 0 AND {_field(d, last, 'type')} = 'bullet' AND {T.bullet_continuation(d, 'v.p', _field(d, last, 'text'))})"
    shorter = f"slice(a.u, 1, CAST({d.size('a.u')} - 1 AS INT))" if d is SPARK else "a.u[1:-2]"
    longer = _both(d, shorter, unit("bullet", f"concat({_field(d, last, 'text')}, ' ', v.p)"))
    bulleted, numbered, headed = "contains(v.p, '•')", d.test("v.p", T.NUMBERED_BULLET), T.heading(d, "v.p")
    done = f"CASE WHEN v.p = '' THEN {flush} WHEN {bulleted} THEN {_both(d, flush, items)} WHEN {numbered} THEN {_both(d, flush, unit('bullet', 'v.p'))} WHEN {goes_on} THEN {longer} WHEN {headed} THEN {_both(d, flush, unit('heading', 'v.p'))} ELSE a.u END"
    open_ = f"CASE WHEN v.p = '' OR {bulleted} OR {numbered} OR {goes_on} OR {headed} THEN '' WHEN a.p = '' THEN v.p ELSE concat(a.p, ' ', v.p) END"
    state = d.fold(elements, d.struct(u=none, p="''"), "a", "v", d.struct(u=done, p=open_))
    last_ = d.map(_one(d, state), "a", flush)
    return d.get(last_, "0")


def joined_lines(d: Dialect, lines: str) -> str:
    """Lines with formulas that were broken across them put together again."""
    none = _none(d, STRINGS)
    elements = d.map(lines, "e", d.struct(b=none, t="e", n="0"))
    joins = f"(a.n > 0 AND {T.strip(d, 'a.t')} <> '' AND {T.strip(d, 'v.t')} <> '' AND {T.joins_next_line(d, T.strip(d, 'a.t'), T.strip(d, 'v.t'))})"
    state = d.fold(
        elements,
        d.struct(b=none, t="''", n="0"),
        "a",
        "v",
        d.struct(
            b=f"CASE WHEN a.n = 0 OR {joins} THEN a.b ELSE {_both(d, 'a.b', _one(d, 'a.t'))} END",
            t=f"CASE WHEN {joins} THEN concat({T.strip(d, 'a.t')}, ' ', {T.strip(d, 'v.t')}) ELSE v.t END",
            n="1",
        ),
    )
    last = d.map(_one(d, state), "z", f"CASE WHEN {_field(d, 'z', 'n')} = 0 THEN {none} ELSE {_both(d, _field(d, 'z', 'b'), _one(d, _field(d, 'z', 't')))} END")
    return d.get(last, "0")


def without_repeats(d: Dialect, lines: str, top: str, bottom: str) -> str:
    """Lines without the run of repeated ones at either end, after blank ends."""
    for keys, forward in ((top, True), (bottom, False)):
        if not forward:
            lines = f"reverse({lines})" if d is SPARK else f"list_reverse({lines})"
        for extra in (f"{T.strip(d, 'v.t')} = ''", f"{'array_contains' if d is SPARK else 'list_contains'}({keys}, {T.repeat_key(d, 'v.t')})"):
            none = _none(d, STRINGS)
            elements = d.map(lines, "e", d.struct(b=none, t="e"))
            body = f"CASE WHEN {d.size('a.b')} = 0 AND {extra} THEN a.b ELSE {_both(d, 'a.b', _one(d, 'v.t'))} END"
            lines = _field(d, d.fold(elements, d.struct(b=none, t="''"), "a", "v", d.struct(b=body, t="''")), "b")
        if not forward:
            lines = f"reverse({lines})" if d is SPARK else f"list_reverse({lines})"
    return lines


def long_split(d: Dialect, text: str, math: str, most: int = 260) -> str:
    """Long prose cut into runs of whole sentences of at most ``most`` characters; other text stays whole."""
    none = _none(d, STRINGS)
    parts = d.split(d.sub(text, f"([.!?。！？])[{T.WS}]+", "\\1\x01"), "\x01")
    elements = d.map(d.keep(d.map(parts, "e", T.strip(d, "e")), "e", "e <> ''"), "e", d.struct(b=none, t="e"))
    new = f"(a.t <> '' AND {d.length('a.t')} + 1 + {d.length('v.t')} > {most})"
    state = d.fold(elements, d.struct(b=none, t="''"), "a", "v", d.struct(b=f"CASE WHEN {new} THEN {_both(d, 'a.b', _one(d, 'a.t'))} ELSE a.b END", t=f"CASE WHEN a.t = '' OR {new} THEN v.t ELSE concat(a.t, ' ', v.t) END"))
    packed = d.map(_one(d, state), "z", _both(d, _field(d, "z", "b"), _one(d, _field(d, "z", "t"))))
    return f"CASE WHEN {d.length(T.strip(d, text))} <= {most} OR {math} OR {d.size(d.get(packed, '0'))} <= 1 THEN {_one(d, text)} ELSE {d.get(packed, '0')} END"
