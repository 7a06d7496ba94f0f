import re
from collections import Counter

from vellumix.llm import line_quality as q


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "a b c d e a b c d e f g",
    "x " * 12,
    "one two three four five six seven eight nine ten.",
    "Ein schöner Satz, der lang genug ist und mit einem Punkt endet.\n\nEin schöner Satz, der lang genug ist und mit einem Punkt endet.",
    "Home | About | News | Contact | Help\nThis is a sentence that carries the document, and it has twelve words.",
    " nbsp is no space " + " ".join(map(str, range(20))) + ".",
    "$$$ " * 30,
    " ".join(str(i) for i in range(200_000)),
]


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x"), (None, TEXTS[5], "x")], "doc_id long, text string, n_words string")


def test_base_measures(spark):
    rows = q.measured(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert tuple(r)[1:] == slow(TEXTS[5 if r.doc_id is None else r.doc_id]), r.doc_id


def test_lines_are_removed_and_documents_rejected(spark):
    good = "Here is a proper sentence with enough words to be kept by every rule."
    other = "Nothing in this second line repeats what was said before, so both of them stay."
    rows = [
        (1, f"{good}\nHome | About | Contact\nread more\n{other}", 9),
        (2, f"Home | About | Contact | News | Login | Shop | Cart | Help | Blog | Jobs\n{good}", 9),
        (3, f"WOW!! THIS!! IS!! SO!! VERY!! LOUD!! THAT!! IT!! GOES!! AWAY!!\n{good}", 9),
        (4, f"{good}\nAll rights reserved.", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = {r.doc_id: r for r in q.clean(df).collect()}
    assert kept[1].text == f"{good}\n{other}" and kept[1].n_chars == len(kept[1].text)
    assert kept[4].text == good and 2 not in kept
    assert kept[3].text == good and set(kept) == {1, 3, 4}
    assert q.clean(df).dtypes == df.dtypes and q.clean(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    assert "Python" not in q.measured(frame(spark))._jdf.queryExecution().toString()


def test_clean_keeps_blank_lines(spark):
    good = "This is a plain sentence of more than ten words, and it ends well."
    other = "Nothing in this second line repeats what was said before, so both of them stay."
    rows = [(1, f"{good}\n\n{other}\n"), (2, f"\n{good}\n \nHome\n\n{other}")]
    kept = {r.doc_id: r.text for r in q.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: rows[0][1], 2: rows[1][1].replace("Home\n", "")}


def test_boilerplate_is_whole_words_that_make_up_the_line(spark):
    clean = "He moved to the capital and took a degree in design in 1998.\nSpread more butter on the bread before you sign in.\nThey read more books in that year than in all the years before it.\nWe want to sign up for the course that begins next week."
    junk = ["Read more »", "Sign in", "Click here now", "© 2020 All rights reserved.", "Alle Rechte vorbehalten", "Lire la suite.", "Todos los derechos reservados 2021.", "Conditions d’utilisation."]
    rows = [(1, clean)] + [(10 + i, f"{clean}\n{j}") for i, j in enumerate(junk)]
    got = {r.doc_id: r.text for r in q.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {i for i, _ in rows} and set(got.values()) == {clean}


def test_columns_called_like_the_operators_own_stay(spark):
    text = "Here is a proper sentence with enough words to be kept by every rule."
    df = spark.createDataFrame([(1, f"{text}\nread more", "a", 7, [1.5], "r", True)], "doc_id long, text string, kept string, n_words int, _good array<double>, row string, `_fence` boolean")
    [r] = q.clean(df).collect()
    assert q.clean(df).schema == df.schema and tuple(r) == (1, text, "a", 7, [1.5], "r", True)
