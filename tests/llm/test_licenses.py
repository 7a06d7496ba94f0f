import random
import textwrap

import pytest

from vellumix.llm import licenses as lic


def brute(block, templates, threshold):
    own = set(lic.words(block.encode()))
    out = []
    for t, (_, text) in enumerate(templates):
        words = set(lic.words(text.encode()))
        c = len(words & own) / len(words)
        if c >= threshold - 1e-9:
            out.append((t, c))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.8, 1.0])
def test_filters_lose_nothing(threshold):
    rng = random.Random(3)
    letters = "abcdefghijklmnop"
    templates = [("x", " ".join(rng.sample(letters, rng.randint(4, 9)))) for _ in range(30)]
    index = lic.Index(templates, {c.encode(): rng.randint(0, 50) for c in letters}, threshold)
    found = 0
    for _ in range(800):
        block = " ".join(rng.choices(letters + "qrst", k=rng.randint(0, 12)))
        got = index.matches(set(lic.words(block.encode())))
        assert got == brute(block, templates, threshold)
        found += len(got)
    assert found > 20


def test_phrases():
    text = b"The MIT License. mit-license, GNU General Public License; public license apache\nlicense"
    assert lic.phrase_places(lic.words(text.lower())) == [(1, "mit"), (3, "mit"), (6, "gpl"), (11, "apache")]


ROWS = [
    (1, None),
    (2, ""),
    (3, "Some prose.\nReleased under the MIT License.\nMore prose."),
    (3, "Some prose.\nReleased under the MIT License.\nMore prose."),
    (4, "Licensed under CC BY-NC 4.0."),
    (None, "LICENSED under the Apache License, version 2.0!"),
    (5, "under the license of the sea " * 20_000),
]


def test_scan(spark, tmp_path):
    df = spark.createDataFrame([(k, t, "x") for k, t in ROWS], "doc_id long, text string, label string")
    got = [(r.doc_id, r.block, r.label, round(r.containment, 3)) for r in lic.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, 1, "mit", 1.0)] * 2 + [(4, 0, "cc-by-nc", 1.0), (4, 0, "cc-by", 1.0), (4, 0, "cc-by-sa", 0.857), (None, 0, "apache", 1.0)], key=repr)
    assert lic.scan(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in lic.op8_licenses(spark, str(tmp_path)).collect()}
    assert tuple(rows[1])[1:] == tuple(rows[2])[1:] == (0, 0, None, None, "", "", 0.0, 0)
    assert tuple(rows[3])[1:] == (9, 1, 5, 5, "mit", "mit", 1.0, 1)
    assert rows[4].labels == "cc-by-nc" and rows[4].base_labels == ""


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        lic.Index([("x", "mit license")], {}, 0.8)


@pytest.mark.parametrize("prefix", ["", " * "])
@pytest.mark.parametrize("template", range(len(lic.TEMPLATES)))
def test_templates_wrapped_at_70_columns(template, prefix):
    index = lic.Index(lic.TEMPLATES, {}, lic.THRESHOLD)
    label, text = lic.TEMPLATES[template]
    notice = "\n".join(prefix + x for x in textwrap.wrap("Copyright 2020 the authors of this. " + text, 70))
    blocks = index.blocks(f"Some prose.\n\n{notice}\n\nMore prose.".encode())
    assert max(c for _, _, hits in blocks for t, c in hits if t == template) >= lic.THRESHOLD
    assert label in {index.labels[t] for _, _, hits in blocks for t, _ in lic.best(hits, index.explained, index.sizes)}
    scattered = "\n".join(" ".join([w, *["filler"] * 40]) for w in text.split())
    assert index.blocks(scattered.encode()) == []


def test_windows_equal_brute_force_over_all_windows():
    """A template is reported if and only if a window of its length, over lines, or a line holds enough of it."""
    rng = random.Random(11)
    letters = "abcdefghijklmnop"
    templates = [("x", " ".join(rng.sample(letters, rng.randint(5, 9)))) for _ in range(12)]
    index, hits = lic.Index(templates, {c.encode(): rng.randint(0, 9) for c in letters}, 0.8), 0
    for _ in range(300):
        lines = [" ".join(rng.choices(letters + "qrstuvw", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 8))]
        every = lic.words("\n".join(lines).encode())
        want = {t for line in lines for t, _ in brute(line, templates, 0.8)}
        for t, (_, text) in enumerate(templates):
            own = set(lic.words(text.encode()))
            if any(len(own & set(every[i : i + len(own)])) >= index.needed[t] for i in range(len(every))):
                want.add(t)
        got = {t for _, _, found in index.blocks("\n".join(lines).encode()) for t, _ in found}
        assert got == want
        hits += len(want)
    assert hits > 10


def test_whole_licenses_in_comments_are_found(spark):
    rows = [(i, "def f():\n    pass\n" + "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, width))) for i, (mark, width, (_, text)) in enumerate((m, w, t) for m in ("#", "//", " *", "") for w in (60, 78) for t in lic.TEMPLATES)]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, r.label) for r in got.collect()}
    assert {(i, lic.TEMPLATES[i % len(lic.TEMPLATES)][0]) for i, _ in rows} <= found
