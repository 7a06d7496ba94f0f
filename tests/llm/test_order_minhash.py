import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumix.llm import order_minhash as m


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


SEQ = st.lists(st.integers(0, 4), max_size=40)


@settings(max_examples=500, deadline=None)
@given(SEQ, SEQ, st.integers(0, 45))
def test_banded_alignment(a, b, most):
    d = levenshtein(a, b)
    assert m.distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == (d if d <= most else None)


def test_alignment_of_long_near_copies():
    rng = random.Random(1)
    a = [rng.randrange(1000) for _ in range(600)]
    b = list(a)
    for _ in range(70):
        k = rng.randrange(3)
        i = rng.randrange(len(b))
        b[i : i + (k > 0)] = [rng.randrange(1000)] * (k < 2)
    assert m.distance(np.array(a), np.array(b), 200) == levenshtein(a, b)


def test_shingles_and_labels():
    h, n = m.shingles([b"a b c d e a b c d e", b"", b"x y", b"a b c d e", b"y x"])
    assert n.tolist() == [6, 0, 1, 1, 1]
    assert h[0] == h[5] == h[7] and h[6] != h[8]
    x = m.labelled(h, n)
    assert x[0] != x[5] and x[0] == x[7] and len(set(x.tolist())) == 8


def slow_sketch(labels, s):
    v = labels * m._odd(s)
    places = sorted(sorted(range(len(v)), key=lambda i: v[i])[: m.PICKS])
    return tuple(int(labels[i]) for i in places)


def test_sketches_are_the_smallest_in_text_order():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=k)).encode() for k in (3, 5, 6, 7, 9, 40, 41, 200)] * 2 + [b""]
    h, n = m.shingles(texts)
    labels = m.labelled(h, n)
    keys = m.sketches(labels, n)
    parts = np.split(labels, np.cumsum(n)[:-1])[: len(keys)]
    for s in (0, 7):
        names = {}
        for part, key in zip(parts, keys[:, s], strict=True):
            assert names.setdefault(slow_sketch(part, s), key) == key
        assert len(set(names.values())) == len(names)


def test_order_matters():
    words = [f"w{i}" for i in range(100)]
    rng = random.Random(3)
    blocks = [words[i : i + 10] for i in range(0, 100, 10)]
    rng.shuffle(blocks)
    a, b = m.parsed(" ".join(words).encode()), m.parsed(" ".join(w for x in blocks for w in x).encode())
    assert len(set(a[1].tolist()) & set(b[1].tolist())) >= 60 and not m.linked(a, b)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, i = [], 0

    def add(text):
        nonlocal i
        rows.append((i * 7 % 1009, text, "x"))
        i += 1

    passage = " ".join(rng.choices(vocabulary, k=12))
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([2, 4, 7, 20, 80, 200]))
        add(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], "more"]])
            add(" ".join(copy))
    base = rng.choices(vocabulary, k=100)
    for _ in range(50):  # a family whose members are near the original, not all near each other
        copy = list(base)
        for k in rng.sample(range(100), rng.randint(1, 5)):
            copy[k] = rng.choice(vocabulary)
        add(" ".join(copy))
    for _ in range(20):  # a passage in common, else nothing
        add(passage + " " + " ".join(rng.choices(vocabulary, k=8)))
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, " ", "x"), (None, rows[0][1], "x"), (2003, rows[0][1], "x"), (2003, rows[0][1], "x"), (2004, "long text " * 30_000, "x"), (2005, "long text " * 30_000 + "end", "x")]
    return rows


def brute(rows):
    texts = sorted({t or "" for _, t, _ in rows})
    own = [m.parsed(t.encode()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if m.linked(own[a], own[b]):
                parent[find(a)] = find(b)
    by = defaultdict(set)
    for i, t, _ in rows:
        by[find(texts.index(t or ""))].add((i, t or ""))
    return {frozenset(x) for x in by.values()}


@pytest.mark.parametrize("rounds", [3, 1])
def test_classes_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(m, "ROUNDS", rounds)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5)
    got = m.classes(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    digests = {bytes(r.d): r.text or "" for r in df.select(m.digest().alias("d"), "text").distinct().collect()}
    for r in got:
        by[bytes(r.class_digest)].add((r.doc_id, digests[bytes(r.digest)]))
        assert r.class_id is not None
    assert {frozenset(x) for x in by.values()} == brute(rows)
    assert all(min(i for i, _ in x if i is not None) == next(r.class_id for r in got if bytes(r.class_digest) == d) for d, x in by.items())
    kept = m.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(by)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.classes(df).count() == 0 and m.one_of_each(df).count() == 0


def test_short_texts_miss_no_links(spark):
    """Pairs of five shingles, four of them shared: each has a chance of 0.005 to be missed by 24 samples, 0.0000001 by all."""
    rng, rows = random.Random(17), []
    for k in range(400):
        words = [f"w{k}x{i}" for i in range(9)]
        other = [*words[:-1], f"w{k}y"] if rng.random() < 0.5 else [f"w{k}y", *words[1:]]
        rows += [(2 * k, " ".join(words), "x"), (2 * k + 1, " ".join(other), "x")]
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[2 * k + 1] for k in range(400)] == [2 * k for k in range(400)]
