import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumix.llm import bloom_lm as b


def test_levels():
    assert b.levels(np.array([0, 1, 2, 3, 20])).tolist() == [0, 1, 2, 3, 20]
    c = np.arange(1, 100_000)
    back = b.count_at(b.levels(c))
    assert (back[:20] == c[:20]).all() and (np.abs(back / c - 1) < 0.016).all()
    assert (np.diff(b.LEVELS) > 0).all() and len(b.COUNTS) < 1 << 16


def test_segments_agree():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for n in (1, 8, 32):
        starts = b._starts(h, n)
        assert [s for s in range(n) for _ in range(starts[s + 1] - starts[s])] == b.segment_of(h, n).tolist()


def part(grams, counts, vocabulary, **options):
    cells, asked, chance = b.build_filter(grams, counts, vocabulary, **options)
    return b.Part(1, [(0, b"", b"", asked, cells)]), chance


def test_filter_reads_every_level_back():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 64, 30_000, dtype=np.uint64))
    counts = np.maximum(1, rng.zipf(1.5, len(h))).clip(max=100_000)
    filter_, _ = part(h, counts, 5000)
    got = filter_.level(h)
    assert (got >= b.levels(counts)).all() and (got == b.levels(counts)).mean() > 0.995
    assert not b.Part(1, []).level(h).any() and not b.Part(1, []).count(h).any()


@pytest.mark.parametrize("load", [4.0, 8.0, 12.0])
def test_false_rate_is_as_expected(load):
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 64, 200_000, dtype=np.uint64))
    filter_, chance = part(h, np.ones(len(h), np.int64), 100, load=load, repeats=1)
    seen = (filter_.level(rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)) > 0).mean()
    assert seen == pytest.approx(chance, rel=0.05) and chance == pytest.approx(b.false_rate(load), rel=0.05)


def test_rare_ngrams_stay_however_many_there_are():
    h = np.unique(np.random.default_rng(4).integers(0, 1 << 64, 400_000, dtype=np.uint64))
    filter_, _ = part(h, np.ones(len(h), np.int64), 10_000)
    assert (filter_.level(h) >= 1).all()


def model_of(texts, order=2, **options):
    """(part, n, v, chance) of some texts."""
    text = b.Slice.of(texts)
    words, counts = np.unique(text.words, return_counts=True)
    grams = np.unique(np.concatenate(text.grams(order)), return_counts=True)
    cells, asked, chance = b.build_filter(*grams, len(words), **options)
    return b.Part(1, [(0, b._sorted(words), b._planes(counts.astype(np.int64)), asked, cells)]), int(counts.sum()), len(words), chance


def found(held, text, order):
    words, grams = b.asked(text, order)
    return b.answered(text, order, held.count(words), held.level(grams))


def test_packed_numbers():
    h = np.sort(np.random.default_rng(9).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (b._hashes(b._sorted(h)) == h).all() and len(b._hashes(b"")) == 0
    for x in (np.arange(-5, 300), np.array([True, False]), np.arange(7, dtype=np.uint16)):
        assert (b._values(b._planes(x), x.dtype) == x).all()


def zipf_texts(tokens, words, seed=6):
    rng = np.random.default_rng(seed)
    ids = rng.choice(words, tokens, p=(w := 1 / np.arange(1, words + 1)) / w.sum())
    return [" ".join(f"w{i}" for i in ids[a : a + 300]).encode() for a in range(0, tokens, 300)]


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one_after_frequent_and_rare_contexts(order):
    texts = zipf_texts(60_000, 5000)
    held, n, v, chance = model_of(texts, order)
    counts = Counter(w for t in texts for w in b.tokens(t))
    every = sorted(counts)
    ranked = [w for w, _ in counts.most_common() if w != b.END]
    rare = [w for w in ranked if counts[w] == 1][:12]
    contexts = [ranked[0], ranked[1], ranked[20], *[w for w in ranked if counts[w] == 6][:6], *rare, b"never"]
    after = {}
    for t in texts:
        own = b.tokens(t)
        for x, y in zip(own, own[1:], strict=False):
            after.setdefault(y, x)
    for context in contexts:
        # Each word of the vocabulary and an unknown one in the context's place: "x context word" as a text.
        lead = after.get(context, b"other") + b" " + context + b" "
        # The end is the sole one of the vocabulary that no text can hold before its end.
        rows = b.Slice.of([lead + w for w in every if w != b.END] + [lead + b"unseen", lead.strip()])
        p = b.probabilities(rows, found(held, rows, order), n, v, chance)
        at = np.append(rows.bounds[1:-1] - 2, rows.bounds[-1] - 1)
        assert p[at].sum() == pytest.approx(1, abs=0.02), context


def chained_texts(tokens, words, seed=7):
    """Each word is mostly followed by one of three."""
    rng = np.random.default_rng(seed)
    after, ids = rng.integers(0, words, (words, 3)), [0]
    while len(ids) < tokens:
        ids.append(after[ids[-1], rng.integers(3)] if rng.random() < 0.8 else rng.integers(words))
    return [" ".join(f"w{i}" for i in ids[a : a + 300]).encode() for a in range(0, tokens, 300)]


def test_a_smaller_filter_never_scores_better():
    texts = chained_texts(60_000, 2000)
    train, other = texts[:160], b.Slice.of(texts[160:])
    means = []
    for load in (4.0, 8.0, 16.0, 32.0, 64.0):
        held, n, v, chance = model_of(train, load=load, repeats=3)
        means.append(np.log10(b.probabilities(other, found(held, other, 2), n, v, chance)).mean())
    assert all(a >= z for a, z in zip(means, means[1:], strict=False)) and means[0] > means[-1] + 0.1, means


def corpus(n=300):
    rng = random.Random(5)
    words = [f"W{i}" for i in range(60)] + ["É", "x\xa0y"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "\n", "\t z"]), "x") for i in range(n)]
    return rows + [(n, None, "x"), (n + 1, "", "x"), (None, "W1 w1", "x"), (3, "again", "x"), (n + 2, "w5 " * 50_000, "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string").select("doc_id", b.held_out().alias("held_out"), "text")


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def expected(rows, order=2):
    """Base columns, and scores by exact counts."""
    counts = [Counter() for _ in range(order)]
    for i, t, _ in rows:
        if crc(i) % 7 != 2:
            own = [b.END] * (order - 1) + b.tokens((t or "").encode())
            for k in range(order):
                counts[k].update(tuple(own[j - k : j + 1]) for j in range(order - 1, len(own)))
    n, v = sum(counts[0].values()), len(counts[0])
    out = []
    for i, t, _ in rows:
        own = b.tokens((t or "").encode())
        base = math.fsum(math.log10((counts[0][w,] + 1) / (n + v + 1)) for w in own)
        padded, score = [b.END] * (order - 1) + own, []
        for j in range(order - 1, len(padded)):
            p = (counts[0][padded[j],] + 1) / (n + v + 1)
            for k in range(1, order):
                context = counts[k - 1][tuple(padded[j - k : j])] if j - k >= order - 2 else counts[0][b.END,]
                if context:
                    p = (counts[k][tuple(padded[j - k : j + 1])] + (w := b.PRIORS.get(k + 1, b.PRIOR)) * p) / (context + w)
            score.append(math.log10(p))
        out.append((i, crc(i) % 7 == 2, len(own), sum(counts[0][w,] > 0 for w in own), n, round(base, 6), math.fsum(score)))
    return sorted(out, key=repr)


def results(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = corpus()
    docs = frame(spark, rows)
    slices, _ = b.tokenized(docs, slice_bytes=1000)
    model, segments = b.train(slices, order=order, repeats=8)
    got, want = results(b.score(slices, model, segments, order)), expected(rows, order)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    # Counts beyond the first levels are within 1.6 %, as is each of a probability's two; a thousandth of levels are one too high.
    off = [abs(x[-1] - y[-1]) / x[2] for x, y in zip(got, want, strict=True)]
    assert np.quantile(off, 0.99) < 0.014 * (order - 1) and max(off) < 0.06 and np.median(off) < 0.002


def test_scores_depend_on_neither_partitions_nor_parts(spark):
    rows, got = corpus(), []
    for partitions, parts in ((1, 1), (13, 1), (5, 3), (2, 16)):
        docs = frame(spark, rows).repartition(partitions)
        slices, _ = b.tokenized(docs)
        model, segments = b.train(slices)
        size = model.agg(F.sum(F.length("filter") + F.length("words") + F.length("word_counts"))).first()[0]
        room = 10 * size if parts == 1 else size // parts
        assert segments == 16 and (b.segments_a_part(model, room) >= segments) == (parts == 1)
        got.append(results(b.score(slices, model, segments, part_bytes=room)))
    assert got[0] == got[1] == got[2] == got[3]


def test_the_model_uses_the_word_before(spark):
    rows = [(i, "a b c d " * 5, "x") for i in range(200)] + [(i, "a c e f g h " * 3, "x") for i in range(200, 260)]
    model, segments = b.train(b.tokenized(frame(spark, rows))[0], segments=3)
    probe, _ = b.tokenized(frame(spark, [(1, "a b c d", "x"), (2, "d c b a", "x")]))
    got = {r.doc_id: r for r in b.score(probe, model, segments).collect()}
    assert got[1].base_score == pytest.approx(got[2].base_score) and got[1].score > got[2].score + 2


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(8)
    texts = [" ".join(f"r{rng.randrange(10**6)}" for _ in range(40)) for _ in range(200)]
    rows = [(i, t, "x") for i, t in enumerate([*texts, *texts[:40]])]
    slices, _ = b.tokenized(frame(spark, rows).withColumn("held_out", F.lit(False)))
    model, segments = b.train(slices)
    got = {r.doc_id: r.score for r in b.score(slices, model, segments).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 200))


def test_empty_tables(spark):
    docs = frame(spark, corpus(3))
    none, _ = b.tokenized(docs.limit(0))
    model, segments = b.train(none, segments=2)
    assert b.score(none, model, segments).count() == 0
    one, _ = b.tokenized(docs.where("doc_id = 4"))
    assert {(r.base_score, r.score) for r in b.score(one, model, segments).collect()} == {(0.0, 0.0)}
