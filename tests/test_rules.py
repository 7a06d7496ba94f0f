"""Scalar rules against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from vellumix.functions import arrays
from vellumix.functions import math as M
from vellumix.functions import protect
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK


@pytest.fixture(scope="module")
def ask(spark):
    def of(rule, *values, **options):
        df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
        return df.select(F.expr(rule(SPARK, *[f"c{i}" for i in range(len(values))], **options)).alias("x")).first().x

    return of


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\x00b\x07c", "abc"),
        ("x  y", "{x | y}|"),
        ("x /∈ A", "x ∉ A"),
        ("a/∈b", "a/∈b"),
        ("a ̸= b", "a ≠ b"),
        ("A ∩ B = /0", "A ∩ B = ∅"),
        ("the path /0 here", "the path /0 here"),
        ("1/0 in the set notation", "1/0 in the set notation"),
        ("/0 /0 ⊆", "∅ ∅ ⊆"),
        ("x" * 60 + " /0 " + "y" * 60 + " ∩", "x" * 60 + " /0 " + "y" * 60 + " ∩"),
        ("", ""),
    ],
)
def test_normalized(ask, text, want):
    assert ask(T.normalized, text) == want


def test_normalize_modes(ask):
    assert ask(T.normalized, "x /∈ A\x07", mode="off") == "x /∈ A"
    assert T.allowed_modes() == ("conservative", "off")
    with pytest.raises(ValueError):
        ask(T.normalized, "x", mode="bold")


@pytest.mark.parametrize(
    "line, want",
    [
        ("1 Introduction", True),
        ("1.2 Sets and Functions", True),
        ("21 Something Else", False),
        ("99999999999 Something", False),
        ("3 Non-linear Systems", False),
        ("1 a b c d e f g h", False),
        ("METHODS AND TOOLS", True),
        ("The Art of Proof", True),
        ("The art of proof", False),
        ("Ends with a Stop.", False),
        ("Introduction", False),
        ("", False),
        ("A " * 60, False),
        ("12", False),
    ],
)
def test_heading(ask, line, want):
    assert ask(T.heading, line) is want


def test_levels_and_front_matter(ask):
    assert [ask(T.heading_level, x) for x in ("1 One", "1.2 Two", "1.2.3) Three", "None")] == [1, 2, 3, 1]
    assert [ask(T.front_matter, x) for x in ("CS 70", "Spring 2024", "My Course  Notes", "Springs 2024", "x")] == [True, True, True, False, False]


@pytest.mark.parametrize("line, bullet, want", [("and more", "x", True), ("More", "x", False), ("More", "let {", True), ("x = 3", "a", True), ("(so)", "a", True), ("2. next", "a:", False), ("• next", "a:", False), ("A ∈ B holds", "a", True), ("A = B holds", "a", True), ("", "a:", False)])
def test_bullet_continuation(ask, line, bullet, want):
    assert ask(T.bullet_continuation, line, bullet) is want


@pytest.mark.parametrize("left, right, want", [("sum ∑n", "i = 1", True), ("x ∈", "A", True), ("x ∈", "∅", False), ("{a", "b | c", True), ("plain", "text", False)])
def test_joins(ask, left, right, want):
    assert ask(T.joins_next_line, left, right) is want


@pytest.mark.parametrize(
    "text, want",
    [("$x$", True), ("$", True), ("", False), ("n = k + 1", True), ("α and β", True), ("This is plain prose.", False), ("a + b = c", True), ("hello world", False), ("x ≤ y ∈ z", False), ("x ≤ y ∈", True), ("word " * 20 + "= + -", False)],
)
def test_math_like(ask, text, want):
    from vellumix.operators import spans

    assert ask(M.math_like, text) is want
    assert spans.is_math(text) is want


def test_math_scalars(ask):
    assert ask(M.signal_score, "x ∈ {a|b}") == 4
    assert ask(M.has_sum_or_product, "∏") is True
    assert ask(M.sum_layout, "∑ n i = 1 i2") == "∑_{i=1}^{n} i2"
    assert ask(M.sum_layout, "x ∑ n i = 1 i2") == "x ∑ n i = 1 i2"
    assert ask(M.squares, "n2 + 32 = 12 ab2c") == "n^2 + 3^2 = 12 ab2c"
    assert ask(M.set_fraction, "{a b | a, b integers}") == "{a/b | a, b integers}"
    assert ask(M.set_fraction, "{a b | a, b reals}") == "{a b | a, b reals}"
    assert ask(M.inline_squares, "n2 + m2, ab2 x") == "n^2 + m^2, ab2 x"
    assert ask(M.inline_squares, "n2 m2") == "n2 m2"
    assert ask(M.tied_relations, "x = y and a∈b and c ∈d") == "x\xa0=\xa0y and a∈b and c\xa0∈d"
    assert ask(M.force_translatable, "non-zero") is True and ask(M.force_translatable, "x - y") is False
    assert [ask(M.worth_translating, x) for x in ("Sets", "CS", "n = k + 1", "12")] == [True, False, False, False]


def test_translation_checks(ask):
    math = "false"
    retry = lambda d, x: T.needs_retry(d, math, x)
    assert ask(retry, "one two three four five six seven eight") is True
    assert ask(retry, "one two three four five six seven") is False
    assert ask(retry, "one two three four five six seven eight " + "字" * 24) is False
    assert ask(T.retry_better, "one two", "字") is True and ask(T.retry_better, "字", "one two") is False and ask(T.retry_better, "a", "  ") is False
    assert ask(T.retry_better, "字", "字") is True and ask(T.retry_better, "字字", "字") is False
    rest = lambda d, x: T.residual_english(d, math, x)
    assert ask(rest, "译文 with") is True and ask(rest, "译文 NASA") is False and ask(rest, "all english") is False


@pytest.mark.parametrize("source, translated, want", [(" Hello. ", "你好", " 你好。 "), ("Why?", "为什么？", "为什么？"), (", and", "和", "，和"), ("  ", "x", "  x  "), ("a", "", "")])
def test_boundaries(ask, source, translated, want):
    assert ask(T.restore_boundaries, source, translated) == want


@pytest.mark.parametrize(
    "url, want",
    [("https://e.x/My%20Paper.v2.PDF?x=1#y", "My-Paper.v2"), ("https://e.x", "document"), ("https://e.x/a/b.pdf/", "b"), ("https://e.x/a+b%ZZ.pdf", "a-b-ZZ"), ("https://e.x/.hidden", "hidden"), ("", "document"), ("https://e.x/%E4%B8%AD.pdf", "document")],
)
def test_base_name(ask, url, want):
    assert ask(T.base_name, url) == want


def test_url_and_upload_checks(ask):
    assert "required" in ask(T.url_error, " ") and "http" in ask(T.url_error, "ftp://x/a.pdf") and ".pdf" in ask(T.url_error, "http://x/a") and ask(T.url_error, "HTTPS://x/a.PDF?b") is None
    assert ask(T.upload_error, "a.PDF") is None and ask(T.upload_error, "") and ask(T.upload_error, "a.doc")
    assert ask(T.upload_name, "../a b?.pdf") == "a-b-.pdf"


def test_lines_and_keys(ask):
    assert ask(T.lines, "a\r\nb\x0bc\u2028d\n") == ["a", "b", "c", "d"] and ask(T.lines, "") == [] and ask(T.lines, "a\n\n") == ["a", ""]
    assert ask(T.repeat_key, "  Page 12 of  340 ") == "page # of #"
    assert ask(T.strip, "\xa0 a\t") == "a"
    assert ask(T.control_count, "a\x00\x7f\n") == 2
    assert ask(T.markdown_sections, "# a\n  ## b\nc # d") == 2


def test_blocks(ask):
    text = "# T\npara one\nstill one\n\n```\ncode\n\nmore\n```\n- item\n| a | b |\n![i](x)\n1. n\nlast\n```\nopen"
    assert ask(arrays.blocks, text) == ["# T", "para one\nstill one", "```\ncode\n\nmore\n```", "- item", "| a | b |", "![i](x)", "1. n", "last", "```\nopen"]
    assert ask(arrays.blocks, "") == [] and ask(arrays.blocks, "```x```\na\n```") == ["```x```\na\n```"]


def test_chunks(ask):
    pack = lambda d, x, most=10: arrays.chunks(d, x, most)
    assert ask(pack, ["aaaa", "bbbb", "cc", "# h", "dddddddddddd", "e"]) == ["aaaa\n\nbbbb", "cc", "# h", "dddddddddddd", "e"]
    assert ask(pack, []) == [""]


def test_units(ask):
    text = "1 Introduction\nSome prose\ngoes on\n\n• one • two\nand more\n\nwhich continues\n2. three\nThe Next Part\nend"
    got = [(u.type, u.text) for u in ask(arrays.units, text)]
    assert got == [("heading", "1 Introduction"), ("paragraph", "Some prose goes on"), ("bullet", "one"), ("bullet", "two and more which continues"), ("bullet", "2. three"), ("heading", "The Next Part"), ("paragraph", "end")]


def test_ends_and_joins(ask):
    rule = lambda d, x, t, b: arrays.without_repeats(d, x, t, b)
    assert ask(rule, ["", "Page 1", "Head", "", "Page 2", "body", "Foot 3", " "], ["page #", "head"], ["foot #"]) == ["", "Page 2", "body"]
    assert ask(arrays.joined_lines, ["sum ∑n", "i = 1 x ∈", "A", "", "x ∈", "", "end"]) == ["sum ∑n i = 1 x ∈ A", "", "x ∈", "", "end"]
    assert ask(arrays.joined_lines, []) == []


def test_long_split(ask):
    cut = lambda d, x, most=20: arrays.long_split(d, x, "false", most)
    assert ask(cut, "One two three. Four five six. Seven.") == ["One two three.", "Four five six.", "Seven."]
    assert ask(cut, "short. text.") == ["short. text."] and ask(cut, "no sentence ends in here at all") == ["no sentence ends in here at all"]


def test_protect_and_restore(spark):
    text = "```\na $x$\n``` and $$d\nd$$ ![i](p) [t](u) $m$ `c` https://e.x/a) $$ `x [l](http://q)`"
    df = protect.protected(spark.createDataFrame([(text,), ("plain",), ("",)], "text string"), "text")
    rows = df.select("*", F.expr(protect.intact(SPARK, "protected", "fragments")).alias("ok"), F.expr(protect.restored(SPARK, "protected", "fragments")).alias("back")).collect()
    first = rows[0]
    assert [f.token for f in first.fragments] == ["[[FENCE_0000]]", "[[DISPLAY_MATH_0001]]", "[[IMAGE_0002]]", "[[LINK_0003]]", "[[LINK_0004]]", "[[INLINE_MATH_0005]]", "[[INLINE_CODE_0006]]", "[[INLINE_CODE_0007]]", "[[URL_0008]]"]
    # The link inside the code was taken before the code, so its token isn't in the text any more.
    assert not first.ok and "[[LINK_0004]]" in first.back
    assert rows[1].ok and rows[1].protected == rows[1].back == "plain" and rows[2].back == ""
