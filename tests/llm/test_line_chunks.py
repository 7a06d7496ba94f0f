import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellumix.llm import line_chunks as q

LINES = [f"line {i} with some words in it" for i in range(400)] + ["", "é"]


def corpus():
    rng = random.Random(6)
    fresh = iter(range(10**6))
    passages = [[rng.choice(LINES) for _ in range(rng.randint(2, 12))] for _ in range(12)]
    rows = []
    for i in range(120):
        own = [f"own {next(fresh)}" if rng.random() < 0.9 else "common line" for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(own), "x"))
    whole = "\n".join(LINES[:40])
    rows += [(200 + i, whole, "x") for i in range(30)] + [(300, whole + "\nand more\nand more", "x")]
    return rows + [(400, None, "x"), (401, "", "x"), (5, rows[5][1], "x"), (6, "another\ntext\nunder\nthe same id", "x"), (None, whole, "x"), (402, "\n".join(f"long {i % 3000}" for i in range(9000)), "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_removed string").repartition(4)


def brute(rows, chunks):
    """From the chunks of each row, what stays of it: of the places of a hash, those with equal bytes belong together."""
    first = defaultdict(list)
    key = lambda i: -(10**9) if i is None else i

    def classes(i, text):
        lines = (text or "").split("\n")
        th, own = chunks[i, text]
        return lines, [((c.h, *lines[c.a : c.b]), (key(i), th, c.a), c) for c in own]

    for i, text, _ in rows:
        for kind, place, _ in classes(i, text)[1]:
            first[kind].append(place)
    out = []
    for i, text, _ in rows:
        lines, own = classes(i, text)
        gone = {k for kind, place, c in own if min(first[kind]) != place for k in range(c.a, c.b)}
        out.append((i, text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("modulus", [None, 40])
def test_equals_brute_force_even_if_hashes_collide(spark, modulus):
    rows = corpus()
    df = frame(spark, rows)
    cut = q.chunked(df.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))), modulus=modulus)
    chunks = {(r.doc_id, r.text): (r.th, r._chunks) for r in cut.collect()}
    got = q.remove_repeats(df, modulus=modulus)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=repr) == brute(rows, chunks)


def test_every_line_stays_somewhere(spark):
    rows = corpus()
    kept = {x for r in q.remove_repeats(frame(spark, rows)).collect() for x in (r.text or "").split("\n")}
    assert {x for _, t, _ in rows for x in (t or "").split("\n") if x} <= kept


def test_copies_lose_their_text_and_inserted_lines_shift_nothing(spark):
    rows = corpus()
    got = {r.doc_id: r for r in q.remove_repeats(frame(spark, rows)).collect()}
    assert got[None].n_removed == 0  # the first by id
    assert all(got[200 + i].text == "" for i in range(30))
    assert got[300].n_removed >= 30
    assert got[400].text is None and got[401].text == ""
    assert got[402].n_removed >= 5000  # repeats inside a text


def test_empty_table_and_no_python(spark):
    df = frame(spark, corpus())
    assert q.remove_repeats(df.limit(0)).count() == 0
    assert "Python" not in q.chunked(df)._jdf.queryExecution().toString()


def test_planted_passages_of_1_to_10_lines_go_whole(spark):
    words = lambda kind, n: " ".join(f"{kind}w{k}" for k in range(n))
    passages = {n: [words(f"p{n}l{k}", 51 if n == 1 else 12) for k in range(n)] for n in range(1, 11)}
    rows, fresh = [], iter(range(10**6))
    for copy in range(6):
        for n, passage in passages.items():
            own = [words(f"own{next(fresh)}", 60) for _ in range(6)]
            at = (copy + n) % 7  # at either end and between
            rows.append((100 * copy + n, "\n".join(own[:at] + passage + own[at:]), "x"))
    got = {r.doc_id: r for r in q.remove_repeats(frame(spark, rows)).collect()}
    for i, text, _ in rows:
        passage = passages[i % 100]
        assert got[i].text.split("\n") == [x for x in text.split("\n") if i < 100 or x not in passage]
        assert got[i].n_removed == (0 if i < 100 else len(passage))


def test_long_lines_alone_and_pairs_across_blank_lines_go_but_shorter_lines_alone_stay(spark):
    long = " ".join(f"w{k}" for k in range(51))
    rows = [(1, f"first\n{long[:-4]}\nfirst too"), (2, f"second\n{long[:-4]}\nsecond too"), (3, long), (4, "own\n" + long), (5, "a b\n\nc d"), (6, "own\na b\n\nc d\n\nown too")]
    got = {r.doc_id: r.text for r in q.remove_repeats(frame(spark, [(*r, "x") for r in rows])).collect()}
    assert [got[i] for i in range(1, 7)] == [rows[0][1], rows[1][1], long, "own", "a b\n\nc d", "own\n\nown too"]


def test_columns_called_like_the_operators_own_stay(spark):
    rows = [(1, "a b\nc d\ne", 5, "x", "y"), (2, "a b\nc d\nf", 99, "z", "w"), (3, "a b\nc d", 1, "z", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _id string, row string")
    assert q.remove_repeats(df).columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, q.deduplicated(df).collect())) == [rows[0], (2, "f", 1, "z", "w")]
    assert q.deduplicated(df).schema == df.schema


def test_recall_of_repeated_passages_against_an_exact_scan(spark):
    """Passages of 2 to 40 lines, each in two documents with fresh lines around it; an exact scan for runs of equal lines says what repeats."""
    rng, fresh = random.Random(12), iter(range(10**6))
    own = lambda: [f"fresh line {next(fresh)} of its own" for _ in range(rng.randint(1, 9))]
    rows = []
    for n in (2, 3, 5, 8, 10, 20, 40):
        for _ in range(20):
            passage = [f"shared line {next(fresh)}" for _ in range(n)]
            rows += [(len(rows) + k, "\n".join(own() + passage + own()), "x") for k in range(2)]
    seen, want = set(), {}
    for i, text, _ in rows:  # each two successive lines that an earlier text has
        lines = text.split("\n")
        pairs = list(zip(lines, lines[1:], strict=False))
        want[i] = {k + d for k, p in enumerate(pairs) if p in seen for d in (0, 1)}
        seen.update(pairs)
    got = {r.doc_id: r.n_removed for r in q.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: len(w) for i, w in want.items()} and sum(got.values()) == 20 * (2 + 3 + 5 + 8 + 10 + 20 + 40)
