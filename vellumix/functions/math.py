"""Rules on formulas in text: what counts as mathematics, and how formulas are tidied."""

from __future__ import annotations

from vellumix.functions.dialect import Dialect
from vellumix.functions.text import WS, strip

# Characters and symbols that speak for a formula.
MATH_CHARACTER = r"[=+\-*/^_<>|()\[\]{}\\]"
FORMULA_CHARACTER = r"[=+\-*/^_|()\[\]{}\\]"
MATH_SYMBOL = "[∑∏√∞≈≤≥≠∈∉⊂⊆∪∩∀∃]"
GREEK_OR_COMMAND = r"\\[a-zA-Z]+|[α-ωΑ-Ω]"
SIGNAL = r"[∑∏∈∉⊆⊂⊇∩∪=≠≤≥{}|\\^·]"
RELATIONS = "∈∉⊆⊂⊇=≠≤≥"
NBSP = "\u00a0"


def has_sum_or_product(d: Dialect, x: str) -> str:
    return d.test(x, "[∑∏]")


def signal_score(d: Dialect, x: str) -> str:
    return d.count(x, SIGNAL)


# Thresholds of what reads as prose or as a formula: characters, words, letters, symbols, tokens, share of mathematical characters.
PROSE_LENGTH, PROSE_WORDS, PROSE_LETTERS = 60, 8, 24
SENTENCE_SYMBOLS, GREEK_TOKENS = 3, 16
DENSE_TOKENS, DENSE_SYMBOLS, DENSE_SHARE = 8, 3, 0.18
EQUATION_TOKENS, EQUATION_SYMBOLS, EQUATION_LETTERS = 6, 2, 20
FEW_WORDS, SOME_SYMBOLS = 2, 2
#: The same as patterns that end where the last word or letter is found.
PROSE = (rf"^[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+){{{PROSE_WORDS - 1}}}[A-Za-z]", rf"^(?:[^A-Za-z]*[A-Za-z]){{{PROSE_LETTERS}}}")


def math_like(d: Dialect, text: str) -> str:
    """Whether a text reads as a formula and not as prose."""
    rest = (
        f"CASE WHEN w >= 1 AND m <= {SENTENCE_SYMBOLS} AND {d.test('x', '[.?!]')} THEN false "
        f"WHEN t <= {GREEK_TOKENS} AND {d.test('x', GREEK_OR_COMMAND)} THEN true "
        f"WHEN t <= {DENSE_TOKENS} AND m >= {DENSE_SYMBOLS} AND CAST({d.count('x', MATH_CHARACTER)} AS DOUBLE) / {d.length('x')} >= {DENSE_SHARE} THEN true "
        f"WHEN t <= {EQUATION_TOKENS} AND contains(x, '=') AND m >= {EQUATION_SYMBOLS} AND {d.count('x', '[A-Za-z]')} <= {EQUATION_LETTERS} THEN true "
        f"ELSE w <= {FEW_WORDS} AND m >= {SOME_SYMBOLS} END"
    )
    for v, count in (("m", f"{d.count('x', MATH_CHARACTER)} + {d.count('x', MATH_SYMBOL)}"), ("w", d.count("x", "[A-Za-z]+")), ("t", d.count("x", f"[^{WS}]+"))):
        rest = d.let(count, v, rest)
    prose = " AND ".join([f"{d.length('x')} >= {PROSE_LENGTH}", *(d.test("x", p) for p in PROSE)])
    return d.let(strip(d, text), "x", f"CASE WHEN x = '' THEN false WHEN {d.test('x', r'^\$')} AND {d.test('x', r'\$$')} THEN true WHEN {prose} THEN false ELSE {rest} END")


def formulaish(d: Dialect, text: str) -> str:
    return d.let(strip(d, text), "f", f"(f <> '' AND ({d.test('f', FORMULA_CHARACTER)} OR {d.test('f', MATH_SYMBOL)} OR ({math_like(d, 'f')})))")


def force_translatable(d: Dialect, text: str) -> str:
    """Fragments that look like formulas but are words."""
    few = f"{d.count('f', MATH_SYMBOL)} + {d.count('f', MATH_CHARACTER)} <= 2"
    return d.let(strip(d, text), "f", f"({d.test('f', f'^[A-Za-z]{{2,}}[{WS}]*-[{WS}]*[A-Za-z]{{2,}}$')} OR {d.test('f', '(?i)^(symbol |denoted by )')} OR ({d.test('f', '[A-Za-z]{4,}')} AND {few}))")


def worth_translating(d: Dialect, heading: str) -> str:
    """Whether a heading has anything to translate."""
    return d.let(strip(d, heading), "h", f"({d.test('h', '[A-Za-z]')} AND NOT ({d.length('h')} <= 3 AND h = upper(h) AND h <> lower(h)) AND NOT ({math_like(d, 'h')}))")


def collapsed(d: Dialect, x: str) -> str:
    return strip(d, d.sub(x, r"[ \t\r\n\f\x0b]+", " "))


def sum_layout(d: Dialect, x: str) -> str:
    """ "∑ n i = 1 body" as "∑_{i=1}^{n} body"."""
    pattern = rf"^([∑∏])[{WS}]*([A-Za-z0-9()+\-]+)[{WS}]+([A-Za-z][{WS}]*=[{WS}]*[A-Za-z0-9+\-]+)[{WS}]+([^\n]+)$"
    index = d.sub(d.first(x, pattern, 3), f"[{WS}]+", "")
    return f"CASE WHEN {d.test(x, pattern)} THEN {d.cat(d.first(x, pattern, 1), d.lit('_{'), index, d.lit('}^{'), d.first(x, pattern, 2), d.lit('} '), strip(d, d.first(x, pattern, 4)))} ELSE {x} END"


def _digit_squares(d: Dialect, x: str) -> str:
    for _ in range(2):  # neighbours share a character
        x = d.sub(x, rf"(^|[^0-9])([0-9])2([{WS}]*(?:[+\-·=]|$))", r"\1\2^2\3")
    return x


def squares(d: Dialect, x: str) -> str:
    """Lost squares in a formula: a letter and 2 at a word's end, a lone digit and 2 before an operator."""
    return _digit_squares(d, d.sub(x, r"([A-Za-z])2($|[^0-9A-Za-z_])", r"\1^2\2"))


def set_fraction(d: Dialect, x: str) -> str:
    """ "{a b |" as "{a/b |" where the set is of rational numbers."""
    return f"CASE WHEN contains(lower({x}), 'integers') OR contains(lower({x}), '∈z') OR contains({x}, '有理数') THEN {d.sub(x, rf'\{{[{WS}]*([A-Za-z])[{WS}]+([A-Za-z])[{WS}]+\|', r'{\1/\2 |')} ELSE {x} END"


def inline_squares(d: Dialect, x: str) -> str:
    """Lost squares in prose with formulas."""
    letters = x
    for _ in range(2):
        letters = d.sub(letters, rf"(^|[^A-Za-z0-9])([A-Za-z])2([{WS}]*(?:[+\-*/=),.;]|$))", r"\1\2^2\3")
    mended = f"CASE WHEN contains({x}, '···') OR {has_sum_or_product(d, x)} THEN {_digit_squares(d, letters)} ELSE {letters} END"
    return f"CASE WHEN {d.test(x, '[=+\\-−∑∏∀∃]')} THEN {mended} ELSE {x} END"


def tied_relations(d: Dialect, x: str) -> str:
    """White space between operands and a relation sign becomes unbreakable."""
    return d.sub(d.sub(x, rf"([A-Za-z0-9)\]}}])[{WS}]+([{RELATIONS}])([{WS}]*[A-Za-z0-9({{\[])", rf"\1{NBSP}\2\3"), rf"([A-Za-z0-9)\]}}][{WS}]*[{RELATIONS}])[{WS}]+([A-Za-z0-9({{\[])", rf"\1{NBSP}\2")
