"""Rules against expectations written down by hand, from the rules' definitions and not from their SQL."""

import pytest
from pyspark.sql import functions as F

from vellumix.functions import math as M
from vellumix.functions import ordered, protect
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK
from vellumix.operators import pages, spans


@pytest.fixture(scope="module")
def ask(spark):
    def of(rule, *values, **options):
        df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(F.expr(rule(SPARK, *[f"c{i}" for i in range(len(values))], **options)).alias("x")).first().x

    return of


@pytest.mark.parametrize(
    "line, want",
    [
        ("ÜÖ ÄÉ", True),  # letters of any alphabet count
        ("第一章 绪论 A", True),
        ("12 34", False),
        ("21 Numbers Above Twenty", False),
        ("20 Numbers", True),
        ("007 Numbers", True),
        ("021 Numbers", False),
        ("2.21 Numbers", True),
        ("100) Numbers", False),
        ("3) on the way", True),
        ("Sets, Maps and Relations", True),
        ("Of the People", False),
        ("é È", False),
        ("ÉCOLE", True),
    ],
)
def test_headings(ask, line, want):
    assert ask(T.heading, line) is want


@pytest.mark.parametrize(
    "line, bullet, want",
    [
        ("A ∩ B holds", "x", True),
        ("A ∪ B holds", "x", True),
        ("A ≠ B holds", "x", True),
        ("The total = 5", "x", False),
        ("A ⊇ B holds", "x", False),
        ("élan", "x", True),
        ("Élan", "x", False),
        ("The sum ∈ of more words than eight are in it", "x", False),
        ("Anything", "such that:", True),
        ("Anything", "a | ", True),
        ("\\alpha", "x", True),
        ("b | c", "x", True),
    ],
)
def test_bullets_that_go_on(ask, line, bullet, want):
    assert ask(T.bullet_continuation, line, bullet) is want


@pytest.mark.parametrize("text, want", [("a < b", False), ("a > b", False), ("a + b", True), ("x_1", True), ("∅ ∈", True), ("plain words", False), ("  ", False), ("α", True)])
def test_formulaish(ask, text, want):
    assert ask(M.formulaish, text) is want


@pytest.mark.parametrize("text, want", [("rate = a*b + c/d", False), ("rate = a", True), ("rate = a + b", True), ("rate = a + b - c", False), ("non-zero", True), ("a-b", False), ("Symbol x", True), ("denoted by ∑∏√", True), ("", False)])
def test_words_that_look_like_formulas(ask, text, want):
    assert ask(M.force_translatable, text) is want
    assert spans._words_like_formulas(text) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("x /∈/∈ A", "x ∉∉ A"),
        ("x/∈ A and /∈", "x/∈ A and ∉"),
        ("/ ∈", "∉"),
        ("A ∩ /0/0 B", "A ∩ ∅/0 B"),
        ("/0" + " " * 46 + "∈", "∅" + " " * 46 + "∈"),
        ("/0" + " " * 47 + "∈", "∅" + " " * 47 + "∈"),
        ("/0" + " " * 48 + "∈", "/0" + " " * 48 + "∈"),
        ("∈" + " " * 47 + "/0", "∈" + " " * 47 + "∅"),
        ("∈" + " " * 48 + "/0", "∈" + " " * 48 + "/0"),
        ("EMPTY \n set: /0", "EMPTY \n set: ∅"),
        ("/0x ∈", "/0x ∈"),
        ("{} /0 and 😀" + "😀" * 45 + "/0", "{} ∅ and 😀" + "😀" * 45 + "/0"),
        ("b ̸ = c", "b ≠ c"),
        ("a", "{a||}"),
    ],
)
def test_symbols(ask, text, want):
    assert ask(T.normalized, text) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://e.x/a%20b%ZZ.pdf", "a-b-ZZ"),
        ("https://e.x/%41%4.pdf", "A-4"),
        ("https://e.x/a+b%2Bc.pdf?q=%20", "a-b-c"),
        ("https://e.x/d/", "d"),
        ("https://e.x/%C3%BC.x", "document"),
        ("https://e.x", "document"),
    ],
)
def test_base_names(ask, url, want):
    assert ask(T.base_name, url) == want


def test_urls_end_at_any_white_space(spark):
    texts = [f"see https://e.x/a{c}then" for c in "　\xa0 \x85 )>]"]
    got = protect.protected(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert [r.fragments[0].value for r in got] == ["https://e.x/a"] * len(texts)
    assert [r.protected for r in got] == [t.replace("https://e.x/a", "[[URL_0000]]") for t in texts]


def test_recognized_text_is_stripped(spark):
    own = spark.createDataFrame([(1, 1, "few"), (1, 2, "x" * 60)], "doc_id long, page_number long, text string")
    got = {r.page_number: r for r in pages.ocr_fallback(own, lambda d, p, lang: "\n  found it 　").collect()}
    assert (got[1].text, got[1].text_len, got[1].used_ocr, got[1].raw_text) == ("found it", 8, True, "few")
    assert (got[2].text, got[2].used_ocr) == ("x" * 60, False)


def parts(text):
    return [(t.strip(), ok) for t, ok in spans.spans(text)]


def test_prose_with_formulas():
    whole = spans.spans("We let $x^2 + y^2$ be small, and go on.")
    assert ("$x^2 + y^2$", False) in whole and "".join(t for t, _ in whole) == "We let $x^2 + y^2$ be small, and go on."
    assert spans.spans("$\\alpha + \\beta = \\gamma$") == [("$\\alpha + \\beta = \\gamma$", False)]
    got = parts("Let B = {1,2,3}, so that the size of B is 3 and we go on to sets.")
    assert ("B = {1,2,3}", False) in got and any(ok and "size of B" in t for t, ok in got)
    got = parts("With n = k + 1 we begin proving the lemma.")
    assert ("n = k + 1", False) in got and any(ok and "proving the lemma" in t for t, ok in got)
    assert any(ok and "non-zero" in t for t, ok in parts("The divisor must be non-zero here."))
    assert parts("f(m)+f(n) as ∑n")[-2:] == [("as", True), ("∑n", False)]
    assert any(not ok and "∑" in t and "i=1" in t for t, ok in parts("We write ∑n i=1 i for the sum and go on."))
    assert any(ok and "[Why?]" in t for t, ok in parts("Note that, if |S| = k, then |P(S)| = 2k. [Why?]"))


def test_long_prose_is_cut_at_sentences():
    sentence = "This sentence has a few words and ends with a full stop, as they do."
    got = spans.spans(" ".join([sentence] * 6))
    assert len(got) == 2 and all(ok and len(t) <= spans.LONGEST for t, ok in got)


def test_mathematics_or_prose():
    for text, want in (("E = mc^2", True), ("This is a plain sentence.", False), ("$", True), ("x", False), ("a word (or two) here.", False)):
        assert spans.is_math(text) is want, text


def test_fingerprints(ask):
    from vellumix.operators import translate

    assert ask(lambda d, a, b: T.fingerprint(d, a, b), "prompt", "policy") == translate.fingerprint("prompt", "policy")


def page(spark, text):
    return spark.createDataFrame([(1, 1, text)], "doc_id long, page_number long, text string")


def test_a_page_of_notes(spark):
    text = "CS 70\nSpring 2026\nCourse Notes\nNote 0\nSome Important Sets\n• Q denotes the set of all rational numbers: {a\nb | a,b ∈Z, b ̸= 0}."
    got = [(r.type, r.text) for r in pages.units(pages.cleaned(page(spark, text))).orderBy("unit_no").collect()]
    assert got == [("heading", "Note 0"), ("heading", "Some Important Sets"), ("bullet", "Q denotes the set of all rational numbers: {a b | a,b ∈Z, b ≠ 0}.")]


def test_formulas_broken_across_lines(spark):
    text = "Mathematical Notation\nWe write ∑n\ni=1 i.\nIf x ∈\nA, then we go on."
    assert pages.cleaned(page(spark, text)).first().text == "Mathematical Notation\nWe write ∑n i=1 i.\nIf x ∈ A, then we go on."


def test_time_grows_with_the_text():
    """Twice the lines take about twice the steps: ranges of a text joined to itself."""
    kinds = [ordered.PLAIN, ordered.FENCE, ordered.PLAIN, ordered.FENCE, ordered.BLANK, ordered.ALONE] * 1000
    one, two = ordered.block_ranges(kinds), ordered.block_ranges(kinds * 2)
    assert len(two) == 2 * len(one) and [(a, b) for _, a, b in two[len(one) :]] == [(a + 6000, b + 6000) for _, a, b in one]
    assert len(ordered.packed_ranges([10] * 1000, [False] * 1000, 100, 2)) == 125


@pytest.mark.parametrize("repeats", [200])
def test_doubling_a_text_doubles_the_time(spark, repeats):
    import time

    from vellumix.operators import markdown

    line = "# T\nSome text with `code` and $x$ at https://e.x/a /0 in the empty set.\n\n- item\n\n```\nx\n\n```\n"

    def seconds(n):
        df = spark.createDataFrame([(i, line * n) for i in range(8)], "doc_id long, text string").repartition(8).cache()
        df.count()
        began = time.perf_counter()
        markdown.translated(df).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        df.unpersist()
        return took

    seconds(10)
    times = [seconds(repeats * k) for k in (1, 4)]
    assert times[1] < 10 * times[0] + 2, times  # four times the text; 16 if time were quadratic
