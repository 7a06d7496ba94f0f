"""Fragments of Markdown behind placeholders, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumix.functions.dialect import DUCK, SPARK, Dialect
from vellumix.functions.text import WS

# Labels in the order of their passes, and what each protects.
PASSES = (
    ("FENCE", r"(?s)```.*?```"),
    ("DISPLAY_MATH", r"(?s)\$\$.*?\$\$"),
    ("IMAGE", r"!\[[^\]]*\]\([^)]+\)"),
    ("LINK", r"(?<!!)\[[^\]]+\]\([^)]+\)"),
    ("INLINE_MATH", r"(?<!\$)\$[^$\n]+\$(?!\$)"),
    ("INLINE_CODE", r"`[^`\n]+`"),
    ("URL", rf"https?://[^{WS})>\]]+"),
)
#: What a text holds if a pass has anything to protect.
HINTS = {"FENCE": "```", "DISPLAY_MATH": "$$", "IMAGE": "![", "LINK": "](", "INLINE_MATH": "$", "INLINE_CODE": "`", "URL": "://"}
MARK = "\x01"


def _token(d: Dialect, label: str, n: str) -> str:
    n = f"({n})"
    text = f"CAST({n} AS {'STRING' if d is SPARK else 'VARCHAR'})"
    return f"concat('[[{label}_', CASE WHEN {n} < 10000 THEN lpad({text}, 4, '0') ELSE {text} END, ']]')"


def _marked(d: Dialect, label: str, pattern: str, x: str) -> str:
    """Every match between two marks. RE2 has no look-around: the check captures the neighbours instead."""
    if d is DUCK and label in ("LINK", "INLINE_MATH"):
        before, own, after = ("(^|[^!\x01])", r"(\[[^\]\x01]+\]\([^)\x01]+\))", "()") if label == "LINK" else ("(^|[^$\x01])", r"(\$[^$\n\x01]+\$)", "($|[^$\x01])")
        for _ in range(2):
            x = d.sub(x, before + own + after, f"\\1{MARK}\\2{MARK}\\3")
        return x
    return d.sub(x, f"({pattern})" if not pattern.startswith("(?s)") else f"(?s)({pattern[4:]})", f"{MARK}\\1{MARK}")


def steps(d: Dialect, label: str, pattern: str, x: str, fragments: str) -> tuple[str, str, str]:
    """Expressions for a pass: the parts; then, over a column of them named ``parts``, the text and the fragments."""
    n = d.size(fragments)
    parts = d.split(_marked(d, label, pattern, x), MARK)
    if d is SPARK:
        parts = f"CASE WHEN contains({x}, '{HINTS[label]}') THEN {parts} ELSE array({x}) END"
    token = _token(d, label, f"{n} + CAST(floor(k / 2) AS BIGINT)")
    text = d.join(d.imap("parts", "p", "k", f"CASE WHEN k % 2 = 1 THEN {token} ELSE p END"), "''")
    none = d.struct(token="''", value="''")
    made = d.keep(d.imap("parts", "p", "k", f"CASE WHEN k % 2 = 1 THEN {d.struct(token=token, value='p')} ELSE {none} END"), "f", "f.token <> ''")
    both = f"concat({fragments}, {made})" if d is SPARK else f"list_concat({fragments}, {made})"
    return parts, text, both


def protected(df: DataFrame, text: str, out: str = "protected", fragments: str = "fragments") -> DataFrame:
    """``df`` with the text behind placeholders and the fragments (token, value) in the order of their numbers."""
    df = df.withColumns({out: F.col(text), fragments: F.expr("CAST(array() AS array<struct<token:string,value:string>>)")})
    for label, pattern in PASSES:
        parts, new, both = steps(SPARK, label, pattern, out, fragments)
        df = df.withColumn("parts", F.expr(parts)).withColumns({out: F.expr(new), fragments: F.expr(both)}).drop("parts")
    return df


def protected_sql(source: str, text: str) -> str:
    """The same as a chain of DuckDB subqueries over ``source``; adds ``protected`` and ``fragments``."""
    sql = f"SELECT *, {text} AS protected, CAST([] AS STRUCT(token VARCHAR, value VARCHAR)[]) AS fragments FROM ({source})"
    for label, pattern in PASSES:
        parts, new, both = steps(DUCK, label, pattern, "protected", "fragments")
        sql = f"SELECT * EXCLUDE (parts, protected, fragments), {new} AS protected, {both} AS fragments FROM (SELECT *, {parts} AS parts FROM ({sql}))"
    return sql


def restored(d: Dialect, text: str, fragments: str) -> str:
    """Tokens replaced by their fragments, in the order of their numbers."""
    elements = d.map(fragments, "f", d.struct(t="''", k="f.token", v="f.value"))
    state = d.fold(elements, d.struct(t=text, k="''", v="''"), "a", "v", d.struct(t="replace(a.t, v.k, v.v)", k="''", v="''"))
    return f"({state}).t" if d is not SPARK else f"{state}.t"


def intact(d: Dialect, text: str, fragments: str) -> str:
    """Whether every token is still in the text."""
    return f"(NOT {d.some(fragments, 'f', f'NOT contains({text}, f.token)')})"
