"""Rules on lines and texts: cleaning, headings, bullets, translation checks.

Each function takes a dialect and SQL text for its operands and returns SQL text; ``column`` makes
a Spark column of it. All are built-in expressions. Operands that a rule reads often are bound once by
``let``; what stands inside that or another lambda is interpreted, with compiled patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumix.functions.dialect import SPARK, Dialect


def column(rule, *operands: str, **options) -> Column:
    """A rule as a Spark column, its operands column names or SQL text."""
    return F.expr(rule(SPARK, *operands, **options))


# Characters that count as white space, and those that end a line.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LAST_END = "\n\\z"
#: The same as literal characters.
WS_CHARACTERS = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Extraction artefacts and what they are mapped to.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PRIVATE_PIECES = (("\uf8f1", "{"), ("\uf8f2", "|"), ("\uf8f3", "}"), ("\uf8f4", "|"))
PRIVATE_USE = r"[\x{e000}-\x{f8ff}]"
# What makes "/0" an empty set when it stands near.
SET_CONTEXT = r"(?i)(∩|∪|⊂|⊆|⊇|∈|∉|\\|\{\}|empty[%s]+set|subset|superset|set[%s]+difference|set[%s]+notation|空集|集合|子集|并集|交集|补集)" % (WS, WS, WS)
SET_CONTEXT_REACH = 48
# Words that a title may have in lower case.
TITLE_CONNECTORS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "without")
LETTER, LOWER = r"\p{L}", r"\p{Ll}"
HEADING_SYMBOL = r"[\[\]{}=<>≈+\-*/^_%]"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)(?:\)|\.)?[WS]+[A-Za-z]".replace("WS", WS)
NUMBER_ABOVE_20 = r"^0*(?:2[1-9]|[3-9][0-9]|[1-9][0-9]{2,})(?:\)|\.)?[WS]".replace("WS", WS)
NUMBERED_BULLET = r"^\d+\.[WS]+[^WS]".replace("WS", WS)
FRONT_MATTER = r"(?i)(^cs[WS]*\d+$|^(spring|summer|fall|winter)[WS]+\d{4}$|course[WS]+notes|discrete[WS]+mathematics)".replace("WS", WS)
# Sentence marks and their full-width counterparts.
MARKS = ((".", "。"), (",", "，"), (";", "；"), (":", "："), ("!", "！"), ("?", "？"))
MODES = ("conservative", "off")


def allowed_modes() -> tuple[str, ...]:
    """The symbol fix modes, sorted."""
    return MODES


def strip(d: Dialect, x: str) -> str:
    if d is SPARK:
        return f"btrim({x}, '{WS_CHARACTERS}')"
    return d.sub(x, f"^[{WS}]+|[{WS}]+$", "")


def strip_end(d: Dialect, x: str) -> str:
    return f"rtrim('{WS_CHARACTERS}', {x})" if d is SPARK else d.sub(x, f"[{WS}]+$", "")


def blank(d: Dialect, x: str) -> str:
    return f"({strip(d, x)} = '')"


def lines(d: Dialect, x: str) -> str:
    """The lines of a text, without an empty one after the last line end."""
    if d is SPARK:
        parts = d.split(d.sub(d.sub("y", LINE_ENDS, chr(10)), LAST_END, ""), chr(10))
        return d.let(x, "y", f"CASE WHEN y = '' THEN CAST(array() AS array<string>) ELSE {parts} END")
    none = d.keep(d.split(x, "x"), "e", "false")
    return f"CASE WHEN {x} = '' THEN {none} ELSE {d.split(d.sub(d.sub(x, LINE_ENDS, chr(10)), LAST_END, ''), chr(10))} END"


def control_count(d: Dialect, x: str) -> str:
    return d.count(x, CONTROL)


def without_controls(d: Dialect, x: str) -> str:
    """Control characters gone, known private-use pieces mapped, others gone."""
    x = d.sub(x, CONTROL, "")
    for piece, by in PRIVATE_PIECES:
        x = f"replace({x}, '{piece}', '{by}')"
    return d.sub(x, PRIVATE_USE, "")


def _before_slash(d: Dialect, x: str, pattern: str, by: str) -> str:
    """Replace slashes and the ``pattern`` after them that follow no ASCII letter or digit."""
    if d is SPARK:
        return d.sub(x, f"/(?<![0-9A-Za-z]/){pattern}", by)
    for _ in range(2):  # without look-behind a match takes the character before it, which may end another
        x = d.sub(x, f"(^|[^0-9A-Za-z])/{pattern}", rf"\1{by}")
    return x


def empty_sets(d: Dialect, x: str) -> str:
    """A lone "/0" becomes the empty set where set notation stands within reach."""
    if d is SPARK:
        return _empty_sets(d, x)
    marked = x
    for _ in range(2):  # neighbours share the character between them
        marked = d.sub(marked, rf"(^|[^0-9A-Za-z\x01])(/[{WS}]*0)($|[^0-9A-Za-z\x01])", "\\1\x01\\2\x01\\3")
    parts = d.split(marked, "\x01")
    before = d.fold(f"({parts})[1:k]", "CAST(0 AS BIGINT)", "n", "q", f"n + {d.length('q')}")
    window = d.part(x, f"greatest({before} - {SET_CONTEXT_REACH}, 0) + 1", f"least({before}, {SET_CONTEXT_REACH}) + {d.length('p')} + {SET_CONTEXT_REACH}")
    mended = d.join(d.imap(parts, "p", "k", f"CASE WHEN k % 2 = 1 AND {d.test(window, SET_CONTEXT)} THEN '∅' ELSE p END"), "''")
    return f"CASE WHEN {d.test(x, f'/[{WS}]*0')} THEN {mended} ELSE {x} END"


def _empty_sets(d: Dialect, x: str) -> str:
    """Spark: what stands around each match is caught by look-around, in one pass, and only where there is a match."""
    slash, zero = "/(?<![0-9A-Za-z]/)", rf"[{WS}]*0(?![0-9A-Za-z])"
    lone = slash + zero
    # Looked for behind the slash, so that only slashes are looked at.
    before = rf"{slash}(?<=(^[\s\S]{{0,{SET_CONTEXT_REACH - 1}}}|[\s\S]{{{SET_CONTEXT_REACH}}})/){zero}"
    after = rf"{lone}(?=([\s\S]{{0,{SET_CONTEXT_REACH}}}))"
    around = f"zip_with(regexp_extract_all(x, {d.lit(before)}, 1), regexp_extract_all(x, {d.lit(after)}, 1), (a, z) -> {d.test('a', SET_CONTEXT)} OR {d.test('z', SET_CONTEXT)})"
    parts = d.split(d.sub("x", f"({lone})", "\x01\\1\x01"), "\x01")
    swapped = d.join(d.imap(parts, "p", "k", "CASE WHEN k % 2 = 1 AND get(near, CAST(floor(k / 2) AS INT)) THEN '∅' ELSE p END"), "''")
    return d.let(x, "x", f"CASE WHEN {d.test('x', lone)} THEN {d.let(around, 'near', swapped)} ELSE x END")


def normalized(d: Dialect, x: str, mode: str = "conservative") -> str:
    """Extraction artefacts repaired; mode "off" stops after control and private-use characters."""
    if mode not in MODES:
        raise ValueError(f"unknown symbol fix mode: {mode}")
    x = without_controls(d, x)
    return x if mode == "off" else empty_sets(d, symbols_repaired(d, x))


def symbols_repaired(d: Dialect, x: str) -> str:
    """Slash and element-of become not-element-of, a combining stroke and equals not-equal."""
    return d.sub(_before_slash(d, x, f"[{WS}]*∈", "∉"), rf"\x{{338}}[{WS}]*=", "≠")


def repeat_key(d: Dialect, x: str) -> str:
    """What a header or footer line is recognized by on other pages."""
    return strip(d, d.sub(d.sub(f"lower({x})", r"\d+", "#"), f"[{WS}]+", " "))


def words(d: Dialect, x: str) -> str:
    return d.keep(d.split(d.sub(x, f"[{WS}]+", " "), " "), "w", "w <> ''")


def title_case(d: Dialect, x: str) -> str:
    """At least two words beside connectors, each beginning upper-case or with a digit."""
    bare = d.keep(d.map(words(d, x), "w", d.sub("w", "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")), "w", "w <> ''")
    own = d.keep(bare, "w", "lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in TITLE_CONNECTORS) + ")")
    low = d.some(own, "w", f"NOT {d.test('w', '^[A-Z0-9]')}")
    return f"({d.size(own)} >= 2 AND NOT {low})"


def heading(d: Dialect, line: str) -> str:
    """Whether a line is a heading."""
    return d.let(strip(d, line), "s", stripped_heading(d, "s"))


def stripped_heading(d: Dialect, s: str) -> str:
    """Whether a stripped line is a heading."""
    n = d.count(s, f"[^{WS}]+")
    return (
        f"CASE WHEN {s} = '' OR {d.length(s)} > 100 OR {d.test(s, '[.,;:]$')} OR {d.test(s, HEADING_SYMBOL)} OR {n} > 10 OR {d.count(s, LETTER)} < 2 THEN false "
        f"WHEN {d.test(s, NUMBERED_HEADING)} THEN {n} <= 8 AND NOT {d.test(s, NUMBER_ABOVE_20)} "
        f"WHEN {s} = upper({s}) AND {s} <> lower({s}) AND {n} <= 6 THEN true "
        f"ELSE {n} <= 8 AND {title_case(d, s)} END"
    )


def heading_level(d: Dialect, line: str) -> str:
    """1, and 1 more for each dot in the number before a heading."""
    number = d.first(strip(d, line), NUMBERED_HEADING, 1)
    return f"(1 + {d.length(number)} - {d.length(f'replace({number}, {chr(39)}.{chr(39)}, {chr(39)}{chr(39)})')})"


def front_matter(d: Dialect, line: str) -> str:
    return d.test(strip(d, line), FRONT_MATTER)


# What a bullet ends with that goes on, and symbols that speak for a line going on with one.
OPEN_END = r"[{\[(=:|]$"
CONTINUING_SYMBOL = "[∈∉⊆⊂∩∪≠]"


def continues(d: Dialect, x: str) -> str:
    """Whether a stripped line that is no heading reads as the rest of something, whatever stands before it."""
    return f"({d.test(x, rf'^(?:[A-Za-z][{WS}]*[|=]|[({{\[|\\/]|{LOWER})')} OR ({d.test(x, CONTINUING_SYMBOL)} AND {d.count(x, f'[^{WS}]+')} <= 8))"


def bullet_continuation(d: Dialect, line: str, bullet: str) -> str:
    """Whether a line goes on with the bullet before it."""
    body = f"CASE WHEN l = '' OR {d.starts('l', chr(39) + '•' + chr(39))} OR {d.test('l', NUMBERED_BULLET)} OR {stripped_heading(d, 'l')} THEN false ELSE {d.test(strip(d, bullet), OPEN_END)} OR {continues(d, 'l')} END"
    return d.let(strip(d, line), "l", body)


# How a line ends that was broken inside a formula, and how the next one begins.
BROKEN = (
    (rf"[∑∏][{WS}]*[A-Za-z0-9]+[{WS}]*$", rf"^[A-Za-z][{WS}]*=[{WS}]*[A-Za-z0-9+\-]"),
    (rf"[∈∉⊆⊂⊇=≠≤≥][{WS}]*$", r"^[A-Za-z0-9({\[]"),
    (rf"\{{[A-Za-z][{WS}]*$", rf"^[A-Za-z][{WS}]*\|"),
)


def joins_next_line(d: Dialect, left: str, right: str) -> str:
    """Whether a formula was broken between two lines."""
    return "(" + " OR ".join(f"({d.test(left, a)} AND {d.test(right, b)})" for a, b in BROKEN) + ")"


def english_words(d: Dialect, x: str) -> str:
    return d.count(x, "[A-Za-z]{2,}")


def cjk_characters(d: Dialect, x: str) -> str:
    return d.count(x, r"[\x{4e00}-\x{9fff}]")


def needs_retry(d: Dialect, source_math: str, translated: str) -> str:
    """Much English left: eight words or more, and more than a third of the Chinese characters."""
    n = english_words(d, translated)
    third = f"CAST(floor({cjk_characters(d, translated)} / 3) AS BIGINT)"
    return f"(NOT {blank(d, translated)} AND NOT {source_math} AND {n} >= 8 AND {n} > {third})"


def retry_better(d: Dialect, before: str, after: str) -> str:
    """Fewer English words are better, then at least as many Chinese characters."""
    a, b = english_words(d, before), english_words(d, after)
    return f"(NOT {blank(d, after)} AND ({b} < {a} OR ({b} = {a} AND {cjk_characters(d, after)} >= {cjk_characters(d, before)})))"


def residual_english(d: Dialect, source_math: str, translated: str) -> str:
    """Some English word that isn't all upper-case stands among Chinese."""
    low = d.some(d.all(translated, "[A-Za-z]{2,}"), "w", "w <> upper(w)")
    return f"(NOT {blank(d, translated)} AND NOT {source_math} AND {cjk_characters(d, translated)} >= 1 AND {low})"


def restore_boundaries(d: Dialect, source: str, translated: str) -> str:
    """The translation with the source's outer white space and sentence marks."""
    head, tail = d.first(source, f"^[{WS}]*"), d.first(source, f"[{WS}]*$")
    s, t = strip(d, source), strip(d, translated)
    ascii_marks, all_marks = "[.,;:!?]", "[.,;:!?。，；：！？]"

    def full(mark: str) -> str:
        return "CASE " + " ".join(f"WHEN {mark} = '{a}' THEN '{b}'" for a, b in MARKS) + " ELSE '' END"

    front = f"CASE WHEN {d.test(s, '^' + ascii_marks)} AND NOT {d.test(t, '^' + all_marks)} THEN {full(d.part(s, '1', '1'))} ELSE '' END"
    back = f"CASE WHEN {d.test(s, ascii_marks + '$')} AND NOT {d.test(t, all_marks + '$')} THEN {full(d.part(s, d.length(s), '1'))} ELSE '' END"
    return f"CASE WHEN {translated} = '' THEN {translated} WHEN {s} = '' OR {t} = '' THEN {d.cat(head, t, tail)} ELSE {d.cat(head, front, t, back, tail)} END"


def cache_key(d: Dialect, model: str, fingerprint: str, x: str) -> str:
    return d.sha256(d.cat(model, "chr(10)", fingerprint, "chr(10)", x))


def fingerprint(d: Dialect, prompt: str, policy: str) -> str:
    return d.part(d.sha256(d.cat(prompt, "chr(10)", policy)), "1", "16")


def fake_translation(d: Dialect, x: str) -> str:
    """The translator for tests and checks."""
    return d.cat("'[ZH] '", x)


def base_name(d: Dialect, url: str) -> str:
    """A file name from a URL's path; what isn't a valid escape stays as it is."""
    path = d.sub(d.sub(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    if d is SPARK:
        # A percent sign without two hexadecimal digits stands for itself; bytes that are no UTF-8 become U+FFFD.
        valid = d.sub(f"replace({path}, '+', '%2B')", "%(?![0-9A-Fa-f]{2})", "%25")
        decoded = f"coalesce(try_url_decode({valid}), {path})"
    else:
        decoded = f"url_decode({path})"
    last = d.first(d.sub(decoded, "/+$", ""), r"[^/]*$")
    stem = d.sub(last, r"([^.].*)\.[^.]*$", r"\1")
    clean = d.sub(d.sub(stem, r"[^A-Za-z0-9._\-]+", "-"), r"^[\-._]+|[\-._]+$", "")
    return f"coalesce(nullif({clean}, ''), 'document')"


def url_error(d: Dialect, url: str) -> str:
    """Why a URL isn't accepted, or null."""
    return f"CASE WHEN {strip(d, url)} = '' THEN 'url is required' WHEN NOT {d.test(url, '(?i)^[' + WS + ']*https?://')} THEN 'url must begin with http:// or https://' WHEN NOT contains(lower({url}), '.pdf') THEN 'url must name a .pdf' END"


def upload_error(d: Dialect, name: str) -> str:
    """Why an uploaded file isn't accepted, or null."""
    return f"CASE WHEN coalesce({name}, '') = '' THEN 'file is required' WHEN NOT lower({name}) LIKE '%.pdf' THEN 'only .pdf files are accepted' END"


def upload_name(d: Dialect, name: str) -> str:
    """A safe name for an uploaded file."""
    clean = d.sub(d.first(name, r"[^/\\]*$"), r"[^A-Za-z0-9._\-]+", "-")
    return f"coalesce(nullif({d.sub(clean, r'^[-._]+|[-._]+$', '')}, ''), 'upload.pdf')"


def markdown_sections(d: Dialect, x: str) -> str:
    """Lines that begin, after white space, with a number sign."""
    return d.size(d.keep(lines(d, x), "e", d.test("e", f"^[{WS}]*#")))
