"""Formulas in prose: detection, placeholders, and spans to translate or to pass through.

Overlaps are resolved and texts are cut at five kinds of places in turn, which built-in functions
can't express, so these run as Arrow batches, row by row without a shuffle.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from vellumix import shared
from vellumix.functions import math as M
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK

# Kinds of formulas in order of precedence.
KINDS = (
    ("sum_product", r"[∑∏]\s*[A-Za-z0-9]+\s*[A-Za-z]\s*=\s*[A-Za-z0-9+\-]+(?:\s*[A-Za-z0-9()^]+)?(?:\s*=\s*[A-Za-z0-9·+\-^()\s]+)?"),
    ("set_builder", r"\{[^{}\n]{0,140}\|[^{}\n]{0,180}\}"),
    ("set_literal", r"[A-Za-z][A-Za-z0-9_]*\s*=\s*\{[A-Za-z0-9,\s+\-*/^._]{1,160}\}"),
    ("union_intersection", r"[A-Za-z0-9{}()\\]+(?:\s*[∩∪\\]\s*[A-Za-z0-9{}()\\]+)+\s*[=≠]\s*[A-Za-z0-9{}()\\∅]+"),
    ("relation", r"[A-Za-z0-9()\\+\-]+\s*[∈∉⊆⊂⊇=≠≤≥]\s*[A-Za-z0-9()\\+\-]+"),
)
# Where prose is cut.
SPECIAL = r"\$[^$]+\$|\\\([^\)]+\\\)|\\\[[^\]]+\\\]|`[^`]+`"
EQUATION = (
    r"\|[^|\n]{1,40}\|"
    r"|[∑∏]\s*[A-Za-z0-9]+\s*[A-Za-z]\s*=\s*[A-Za-z0-9+\-]+\s*[A-Za-z0-9()^]*"
    r"|\b[A-Za-z][A-Za-z0-9_]*\s*=\s*(?:\{[^{}\n]{1,80}\}|[A-Za-z0-9_(){}\[\]\\.^]+(?:\s*[+\-*/^]\s*[A-Za-z0-9_(){}\[\]\\.^]+){0,8})"
    r"|\b[A-Za-z0-9_]+(?:\s*[+\-*/^]\s*[A-Za-z0-9_]+)+\b"
)
CONNECTOR = r"\b(?:as|or|and)\b"
LONGEST = 260
MATH_TOKEN = r"\[\[MATH_\d{4}\]\]"

#: A text without one of a kind's characters has none of its formulas.
NEEDS = {"sum_product": "∑∏", "set_builder": "|", "set_literal": "{", "union_intersection": "∩∪\\", "relation": "∈∉⊆⊂⊇=≠≤≥"}
_KINDS = [(kind, re.compile(f"[{re.escape(NEEDS[kind])}]"), re.compile(p)) for kind, p in KINDS]
_PROSE = [re.compile(p) for p in M.PROSE]
_SPECIAL, _EQUATION, _CONNECTOR = re.compile(f"({SPECIAL})"), re.compile(f"({EQUATION})"), re.compile(f"({CONNECTOR})", re.I)
_SIGNAL, _SYMBOL, _CHARACTER, _FORMULA, _GREEK = (re.compile(p) for p in (M.SIGNAL, M.MATH_SYMBOL, M.MATH_CHARACTER, M.FORMULA_CHARACTER, M.GREEK_OR_COMMAND))
_WORD, _LETTERS3 = re.compile("[A-Za-z]+"), re.compile("[A-Za-z]{3,}")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


class Formula(NamedTuple):
    start: int
    end: int
    text: str
    kind: str

    @property
    def weight(self) -> tuple[int, int]:
        return len(_SIGNAL.findall(self.text)), self.end - self.start


def formulas(text: str) -> list[Formula]:
    """Formulas that don't overlap, in order: of two that do, the one with more signals, then the longer, stays."""
    every = [Formula(*m.span(), m.group(), kind) for kind, need, p in _KINDS if need.search(text) for m in p.finditer(text)]
    fit = [f for f in every if len(f.text.strip()) >= 3 and f.weight[0] >= 2 and not (f.kind == "set_builder" and len(_LETTERS3.findall(f.text)) > 1)]
    out: list[Formula] = []
    for f in sorted(fit, key=lambda f: (f.start, -f.end)):
        if out and f.start < out[-1].end:
            out[-1] = max(out[-1], f, key=lambda x: x.weight)
        else:
            out.append(f)
    return out


def behind_tokens(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with formulas as [[MATH_0001]] and so on, and (token, formula) pairs."""
    out, at, pairs = [], 0, []
    for n, f in enumerate(formulas(text), 1):
        token = f"[[MATH_{n:04d}]]"
        out += [text[at : f.start], token]
        at = f.end
        pairs.append((token, f.text))
    return "".join([*out, text[at:]]), pairs


def is_math(text: str) -> bool:
    """``math.math_like`` for one string."""
    x = text.strip()
    if not x:
        return False
    if x[0] == x[-1] == "$":
        return True
    if len(x) >= M.PROSE_LENGTH and all(p.match(x) for p in _PROSE):
        return False
    words, tokens, characters = _WORD.findall(x), len(x.split()), len(_CHARACTER.findall(x))
    signs = characters + len(_SYMBOL.findall(x))
    if words and signs <= M.SENTENCE_SYMBOLS and any(c in x for c in ".?!"):
        return False
    dense = tokens <= M.DENSE_TOKENS and signs >= M.DENSE_SYMBOLS and characters / len(x) >= M.DENSE_SHARE
    short = tokens <= M.EQUATION_TOKENS and "=" in x and signs >= M.EQUATION_SYMBOLS and sum(map(len, words)) <= M.EQUATION_LETTERS
    return bool(dense or short or (len(words) <= M.FEW_WORDS and signs >= M.SOME_SYMBOLS) or (tokens <= M.GREEK_TOKENS and _GREEK.search(x)))


def _sentences(text: str) -> list[str]:
    parts = [p.strip() for p in _SENTENCE.split(text) if p]
    if len(text.strip()) <= LONGEST or len(parts) < 2 or is_math(text):
        return [text]
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and len(out[-1]) + 1 + len(p) > LONGEST:
            out.append(p)
        else:
            out[-1] = f"{out[-1]} {p}".strip()
    return out if len(out) > 1 else [text]


def _prose(text: str) -> list[tuple[str, bool]]:
    return [(p, True) for p in _sentences(text)]


def _around_formulas(text: str) -> list[tuple[str, bool]]:
    """Formulas passed through; what is between them by what it looks like."""
    out, at = [], 0
    for f in formulas(text):
        out += [(text[at : f.start], None), (f.text, False)]
        at = f.end
    return [(t, not is_math(t) if ok is None else ok) for t, ok in [*out, (text[at:], None)] if t]


def _connected(text: str) -> list[tuple[str, bool]]:
    """A formula's parts around "as", "or" and "and", where some are translated and some aren't; else nothing."""
    if not (_CONNECTOR.search(text) and (is_math(text) or _EQUATION.fullmatch(text))):
        return []
    formula = lambda t: t.strip() and (_FORMULA.search(t) or _SYMBOL.search(t) or is_math(t))
    out = [(t, bool(i % 2) or not formula(t)) for i, t in enumerate(_CONNECTOR.split(text)) if t]
    return out if {ok for _, ok in out} == {True, False} else []


def _words_like_formulas(text: str) -> bool:
    x = text.strip()
    hyphen = re.fullmatch(r"[A-Za-z]{2,}\s*-\s*[A-Za-z]{2,}", x)
    return bool(hyphen or x.lower().startswith(("symbol ", "denoted by ")) or (re.search("[A-Za-z]{4,}", x) and len(_SYMBOL.findall(x)) + len(_CHARACTER.findall(x)) <= 2))


def spans(text: str) -> list[tuple[str, bool]]:
    """(text, translatable) spans of a normalized paragraph."""
    out: list[tuple[str, bool]] = []
    for i, piece in enumerate(_SPECIAL.split(text)):
        if i % 2:
            out.append((piece, False))
            continue
        for fragment in filter(None, _EQUATION.split(piece)):
            if parts := _connected(fragment):
                out += parts
                continue
            for own, ok in _around_formulas(fragment):
                whole = ok and _EQUATION.fullmatch(own)
                out += _prose(own) if ok and (_words_like_formulas(own) if whole else True) else [(own, False)]
    return out or [(text, not is_math(text))]


def _record(**fields: K.DataType) -> K.StructType:
    return K.StructType([K.StructField(n, k) for n, k in fields.items()])


def _listed(**fields: K.DataType) -> K.ArrayType:
    return K.ArrayType(_record(**fields))


def _lists(rows: list[list[tuple]], **kinds: pa.DataType) -> pa.Array:
    """Lists of records, column by column."""
    flat = list(zip(*(record for row in rows for record in row), strict=True)) or [()] * len(kinds)
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    records = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds.values(), strict=True)], names=list(kinds))
    return pa.ListArray.from_arrays(offsets, records)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


@F.arrow_udf(_listed(text=K.StringType(), translatable=K.BooleanType()))
def _spans(texts: pa.Array) -> pa.Array:
    return _lists([[(t, bool(ok)) for t, ok in spans(x)] for x in _texts(texts)], text=pa.string(), translatable=pa.bool_())


@F.arrow_udf(_listed(start=K.IntegerType(), end=K.IntegerType(), text=K.StringType(), kind=K.StringType()))
def _formulas(texts: pa.Array) -> pa.Array:
    return _lists([formulas(x) for x in _texts(texts)], start=pa.int32(), end=pa.int32(), text=pa.string(), kind=pa.string())


@F.arrow_udf(_record(protected=K.StringType(), fragments=_listed(token=K.StringType(), value=K.StringType())))
def _behind(texts: pa.Array) -> pa.Array:
    made = [behind_tokens(x) for x in _texts(texts)]
    fragments = _lists([pairs for _, pairs in made], token=pa.string(), value=pa.string())
    return pa.StructArray.from_arrays([pa.array([t for t, _ in made], pa.string()), fragments], names=["protected", "fragments"])


def with_spans(df: DataFrame, text: str = "text", mode: str = "conservative") -> DataFrame:
    """``df`` with ``spans`` of the normalized text."""
    shared.ship(df.sparkSession)
    clean = shared.fenced(df.withColumn("_clean", T.column(T.normalized, f"coalesce({text}, '')", mode=mode)))
    return clean.withColumn("spans", _spans(F.col("_clean"))).drop("_clean")


def with_formulas(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``formulas`` (start, end, text, kind) of the text; offsets count code points."""
    shared.ship(df.sparkSession)
    return df.withColumn("formulas", _formulas(F.col(text)))


def protected(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``protected`` and ``fragments`` (token, value)."""
    shared.ship(df.sparkSession)
    return df.withColumn("_both", _behind(F.col(text))).select("*", "_both.*").drop("_both")


def restored(df: DataFrame, text: str, fragments: str = "fragments") -> DataFrame:
    """``df`` with ``restored``, and ``missing`` and ``unexpected`` tokens."""
    from vellumix.functions import protect

    out = df.withColumn("missing", F.transform(F.filter(fragments, lambda f: ~F.contains(F.col(text), f["token"])), lambda f: f["token"]))
    out = out.withColumn("restored", F.expr(protect.restored(SPARK, text, fragments)))
    known = F.transform(fragments, lambda f: f["token"])
    seen = F.when(F.size(fragments) > 0, F.regexp_extract_all("restored", F.lit(f"({MATH_TOKEN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("unexpected", F.filter(seen, lambda t: ~F.array_contains(known, t)))


def stable_layout(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``stable``: its formulas' lost squares, bounds and fractions repaired and their spaces tied."""
    e = lambda rule, x: F.expr(rule(SPARK, x))
    out = protected(df, text)
    found = out.withColumn("_kinds", F.transform(_formulas(F.col(text)), lambda f: f["kind"]))
    fixed = "CASE WHEN k = 'sum_product' THEN {s} WHEN k = 'set_builder' THEN {b} ELSE {w} END"
    ws = M.collapsed(SPARK, "f.value")
    value = fixed.format(s=M.squares(SPARK, M.sum_layout(SPARK, ws)), b=M.set_fraction(SPARK, ws), w=ws)
    mended = found.withColumn("fragments", F.expr(f"zip_with(fragments, _kinds, (f, k) -> named_struct('token', f.token, 'value', {value}))"))
    tied = f"CASE WHEN {M.has_sum_or_product(SPARK, 'f.value')} THEN replace({M.tied_relations(SPARK, 'f.value')}, ' ', '{M.NBSP}') ELSE {M.tied_relations(SPARK, 'f.value')} END"
    mended = mended.withColumn("fragments", F.expr(f"transform(fragments, f -> named_struct('token', f.token, 'value', {tied}))"))
    out = restored(mended, "protected").withColumn("_whole", e(M.set_fraction, "restored"))
    return out.withColumn("stable", e(M.inline_squares, "_whole")).drop("_whole", "_kinds", "protected", "fragments", "missing", "unexpected", "restored")


def span_rows(df: DataFrame) -> DataFrame:
    """A row for each span of (doc_id, spans): (doc_id, span_index, text, translatable)."""
    return df.select("doc_id", F.posexplode("spans").alias("span_index", "s")).select("doc_id", F.col("span_index").cast("long").alias("span_index"), "s.*")


def to_translate(rows: DataFrame) -> Column:
    """Whether a span row needs the translator."""
    return F.col("translatable") & (T.column(T.strip, "text") != "")
