"""Ordered rules that carry a state from line to line, for Spark.

Text never leaves the JVM and is read once: built-in expressions give each line a few flags or a
length, an Arrow function turns a row's numbers into ranges of lines, in one pass over them, and
built-in expressions cut the text by the ranges. What depends on two neighbours only needs no function.
Time and memory grow with a row's lines and characters; nothing is shuffled.

``arrays`` has the same rules as folds in SQL, which check these.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from vellumix import shared
from vellumix.functions import arrays
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK

D = SPARK
RANGES = K.ArrayType(K.StructType([K.StructField(n, K.IntegerType()) for n in ("kind", "a", "b")]))
_RANGES = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))


def _ranges(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "a": a, "b": b} for k, a, b in row] for row in rows], _RANGES)


# Kinds of Markdown lines.
PLAIN, FENCE, BLANK, ALONE = range(4)


def block_ranges(kinds: list[int]) -> list[tuple[int, int, int]]:
    """Lines (from, to) of each block, by the lines' kinds: fences whole, lone lines by themselves, else runs."""
    cuts, gone, fenced = [], set(), False
    for i, kind in enumerate(kinds):
        if fenced:
            if kind == FENCE:
                cuts.append(i + 1)
                fenced = False
        elif kind == FENCE:
            cuts.append(i)
            fenced = True
        elif kind != PLAIN:
            cuts += [i, i + 1]
            if kind == BLANK:
                gone.add(i)
    edges = sorted({0, len(kinds), *cuts})
    return [(0, a, b) for a, b in zip(edges, edges[1:], strict=False) if a not in gone]


def packed_ranges(sizes: list[int], firsts: list[bool], most: int, between: int) -> list[tuple[int, int, int]]:
    """Runs of pieces that with ``between`` characters between them have ``most`` at most, or one piece; a ``first`` begins one."""
    starts, held = [], 0
    for i, (size, first) in enumerate(zip(sizes, firsts, strict=True)):
        if i == 0 or first or held + between + size > most:
            starts.append(i)
            held = size
        else:
            held += between + size
    return [(0, a, b) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=False)]


# Kinds of units, and flags of a page's lines.
PARAGRAPH, HEADING, NUMBERED, BULLETS = range(4)
UNIT_NAMES = ("paragraph", "heading", "bullet", "bullet")
F_BLANK, F_BULLETS, F_NUMBERED, F_HEADING, F_CONTINUES, F_OPEN, F_ITEMS = (1 << i for i in range(7))


def unit_ranges(flags: list[int]) -> list[tuple[int, int, int]]:
    """(kind, from, to) of each unit, by the lines' flags."""
    out: list[list[int]] = []
    running = bullet_open = False  # whether the last unit may take another line: a paragraph, or a bullet that is open
    for i, flag in enumerate(flags):
        bullet = bool(out) and out[-1][0] in (NUMBERED, BULLETS)
        if flag & F_BLANK:
            running = False
        elif flag & (F_BULLETS | F_NUMBERED):
            running = False
            if flag & F_NUMBERED and not flag & F_BULLETS or flag & F_ITEMS:
                out.append([BULLETS if flag & F_BULLETS else NUMBERED, i, i + 1])
                bullet_open = bool(flag & F_OPEN)
        elif not running and bullet and not flag & F_HEADING and (bullet_open or flag & F_CONTINUES):
            out[-1][2] = i + 1
            bullet_open = bool(flag & F_OPEN)
        elif flag & F_HEADING:
            running = False
            out.append([HEADING, i, i + 1])
        elif running:
            out[-1][2] = i + 1
        else:
            running = True
            out.append([PARAGRAPH, i, i + 1])
    return [(k, a, b) for k, a, b in out]


@F.arrow_udf(RANGES)
def _blocks(kinds: pa.Array) -> pa.Array:
    return _ranges([block_ranges(row or []) for row in kinds.to_pylist()])


@F.arrow_udf(RANGES)
def _units(flags: pa.Array) -> pa.Array:
    return _ranges([unit_ranges(row or []) for row in flags.to_pylist()])


@F.arrow_udf(RANGES)
def _packed(sizes: pa.Array, firsts: pa.Array, most: pa.Array, between: pa.Array) -> pa.Array:
    each = zip(sizes.to_pylist(), firsts.to_pylist(), most.to_pylist(), between.to_pylist(), strict=True)
    return _ranges([packed_ranges(s or [], f or [], m, b) for s, f, m, b in each])


# Called once a row: the optimizer moves none of these into what reads their column.
_blocks, _units, _packed = (f.asNondeterministic() for f in (_blocks, _units, _packed))


def _cut(pieces: str, separator: str, ranges: str = "_ranges") -> str:
    return f"transform({ranges}, r -> array_join(slice({pieces}, r.a + 1, r.b - r.a), {separator}))"


def with_blocks(df: DataFrame, text: str = "text", out: str = "blocks") -> DataFrame:
    """``df`` with the Markdown blocks of its text: fences whole, headings, list items, images and table rows each alone, else runs of lines."""
    shared.ship(df.sparkSession)
    fence, blank = f"{D.starts('s', chr(39) + '```' + chr(39))}", "s = ''"
    kind = f"CASE WHEN {blank} THEN {BLANK} WHEN {fence} THEN {FENCE} WHEN {D.test('s', arrays.STANDALONE)} THEN {ALONE} ELSE {PLAIN} END"
    own = df.withColumn("_lines", F.expr(T.lines(D, text))).withColumn("_ranges", _blocks(F.expr(D.map("_lines", "e", D.let(T.strip(D, "e"), "s", kind)))))
    blocks = D.keep(D.map(_cut("_lines", "chr(10)"), "e", "btrim(e, chr(10))"), "e", "e <> ''")
    return own.withColumn(out, F.expr(blocks)).drop("_lines", "_ranges")


def with_packed(df: DataFrame, pieces: str, firsts: Column, most: int, separator: str, out: str) -> DataFrame:
    """``df`` with runs of an array's ``pieces``, of ``most`` characters at most or one piece, put together."""
    if most < 1:
        raise ValueError("a chunk needs room")
    shared.ship(df.sparkSession)
    sizes = F.transform(pieces, lambda e: F.length(e))
    own = df.withColumn("_ranges", _packed(sizes, firsts, F.lit(most), F.lit(len(separator))))
    return own.withColumn(out, F.expr(_cut(f"`{pieces}`", f"'{separator}'".replace("\n", "\\n")))).drop("_ranges")


def with_chunks(df: DataFrame, most: int, blocks: str = "blocks", out: str = "chunks") -> DataFrame:
    """``df`` with its blocks packed in order into chunks of at most ``most`` characters; headings begin one. No blocks make one empty chunk."""
    own = with_packed(df, blocks, F.expr(D.map(blocks, "e", D.test("e", f"^[{T.WS}]*#"))), most, "\n\n", out)
    return own.withColumn(out, F.when(F.size(blocks) == 0, F.array(F.lit(""))).otherwise(F.col(out)))


def with_long_split(df: DataFrame, text: str, math: Column, out: str, most: int = 260) -> DataFrame:
    """``df`` with long prose cut into runs of whole sentences of at most ``most`` characters; other text stays whole."""
    parts = D.split(D.sub(text, f"([.!?。！？])[{T.WS}]+", "\\1\x01"), "\x01")
    own = df.withColumns({"_long": F.expr(f"{D.length(T.strip(D, text))} > {most}") & ~math, "_parts": F.expr(D.keep(D.map(parts, "e", T.strip(D, "e")), "e", "e <> ''"))})
    own = with_packed(own, "_parts", F.expr("transform(_parts, e -> false)"), most, " ", "_runs")
    return own.withColumn(out, F.when(F.col("_long") & (F.size("_runs") > 1), F.col("_runs")).otherwise(F.array(F.col(text)))).drop("_long", "_parts", "_runs")


def with_units(df: DataFrame, text: str = "text", out: str = "units") -> DataFrame:
    """``df`` with a page's headings, bullets and paragraphs, in order, as (type, text)."""
    shared.ship(df.sparkSession)
    flags = " + ".join(
        f"CASE WHEN {test} THEN {flag} ELSE 0 END"
        for flag, test in (
            (F_NUMBERED, D.test("s", T.NUMBERED_BULLET)),
            (F_HEADING, T.stripped_heading(D, "s")),
            (F_CONTINUES, T.continues(D, "s")),
            (F_OPEN, D.test("s", T.OPEN_END)),
        )
    )
    # Of a line of bullets what counts is its last item; marks after that go.
    bulleted = f"{F_BULLETS} + CASE WHEN s = '' THEN 0 ELSE {F_ITEMS} END + CASE WHEN {D.test('s', T.OPEN_END)} THEN {F_OPEN} ELSE 0 END"
    without_marks = f"btrim(e, '•{T.WS_CHARACTERS}')"
    flag = f"CASE WHEN e = '' THEN {F_BLANK} WHEN contains(e, '•') THEN {D.let(without_marks, 's', bulleted)} ELSE {D.let('e', 's', flags)} END"
    own = df.withColumn("_lines", F.expr(D.map(T.lines(D, text), "e", T.strip(D, "e"))))
    own = own.withColumn("_ranges", _units(F.expr(D.map("_lines", "e", flag))))
    joined = f"array_join(filter(transform(slice(_lines, r.a + 1, r.b - r.a), (e, i) -> CASE WHEN i = 0 AND r.kind = {BULLETS} THEN {without_marks} ELSE e END), e -> e <> ''), ' ')"
    one = f"array(named_struct('type', CASE r.kind WHEN {PARAGRAPH} THEN 'paragraph' WHEN {HEADING} THEN 'heading' ELSE 'bullet' END, 'text', t))"
    items = f"transform(filter(transform(split(t, '•'), e -> {T.strip(D, 'e')}), e -> e <> ''), e -> named_struct('type', 'bullet', 'text', e))"
    made = f"flatten(transform(_ranges, r -> {D.let(joined, 't', f'CASE WHEN r.kind = {BULLETS} THEN {items} ELSE {one} END')}))"
    return own.withColumn(out, F.expr(made)).drop("_lines", "_ranges")


def joined_lines(lines: str) -> str:
    """Lines with formulas that were broken across them put together again: a line joins the one before by their ends."""
    flags = " + ".join(f"CASE WHEN {D.test('s', p)} THEN {1 << i} ELSE 0 END" for i, p in enumerate([p for pair in T.BROKEN for p in pair]))
    each = D.map(lines, "e", D.let(T.strip(D, "e"), "s", f"named_struct('s', s, 'raw', e, 'f', {flags})"))
    meets = " OR ".join(f"(get(xs, i - 1).f & {1 << 2 * k}) > 0 AND (get(xs, i).f & {2 << 2 * k}) > 0" for k in range(len(T.BROKEN)))
    starts = f"filter(sequence(0, size(xs) - 1), i -> i = 0 OR NOT ({meets}))"
    text = "CASE WHEN z - a = 1 THEN get(xs, a).raw ELSE array_join(transform(slice(xs, a + 1, z - a), x -> x.s), ' ') END"
    groups = D.let(starts, "at", f"transform(at, (a, k) -> {D.let('coalesce(get(at, k + 1), size(xs))', 'z', text)})")
    return D.let(each, "xs", f"CASE WHEN size(xs) = 0 THEN transform(xs, x -> x.raw) ELSE {groups} END")


def without_repeats(lines: str, top: str, bottom: str) -> str:
    """Lines without blank ones at either end, then without the run of repeated ones there."""

    def shorter(xs: str, keys: str) -> str:
        own = f"NOT coalesce(array_contains({keys}, {T.repeat_key(D, 'e')}), false)"
        first = f"array_position(transform(xs, (e, i) -> i + 1 >= n AND (size({keys}) = 0 OR {own})), true)"
        begin = D.let(f"array_position(transform(xs, e -> {T.strip(D, 'e')} <> ''), true)", "n", f"CASE WHEN n = 0 THEN 0 ELSE {first} END")
        return D.let(xs, "xs", D.let(begin, "b", "CASE WHEN b = 0 THEN slice(xs, 1, 0) ELSE slice(xs, CAST(b AS INT), size(xs)) END"))

    return f"reverse({shorter(f'reverse({shorter(lines, top)})', bottom)})"
