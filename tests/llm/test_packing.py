import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumix.llm import _common, packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(0, 30))
def test_fullest_is_the_best_subset_sum(lengths, room):
    chosen = packing.fullest(Counter(lengths), room)
    assert all(n <= lengths.count(x) for x, n in chosen.items())
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=20))
def test_plan_uses_every_piece_once(counts):
    patterns = packing.plan(counts, 50)
    used = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= 50
        used.update({x: n * times for x, n in pattern.items()})
    assert used == Counter(counts)


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = Counter(min(4096, int(rng.lognormvariate(6.3, 0.9)) + 1) for _ in range(20_000))
    bins = sum(times for _, times in packing.plan(counts))
    assert bins <= 1.002 * sum(x * n for x, n in counts.items()) / 4096 + 1


def test_too_long_is_refused():
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé́̀ \n\t\x1c \xa0'sx9ß漢😀<|endoftext|>-.!"), max_size=40), min_size=1, max_size=4))
def test_words_encode_as_whole_texts(texts):
    global ENCODER
    ENCODER = globals().get("ENCODER") or packing.WordIds(packing.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ENCODER.encode(texts) == want


def check(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "hello world", "hello world"] + [" ".join(rng.choices("the of Straße 12 <|endoftext|> naïve".split(), k=rng.randint(1, 900))) for _ in range(200)] + ["long " * 30_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, "hello world", 0), (None, "x", 0)], "doc_id long, text string, length int").repartition(5)
    rows = packing.pack_documents(df).collect()
    encoder = packing.WordIds(packing.tokenizer_path())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(by) == len(texts) + 1 and len(by[3]) == 2
    for i, t in enumerate(texts):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i])
        assert got == sorted(want * (2 if i == 3 else 1))
    total = sum(r.length for r in rows)
    assert check(rows) <= total // 4096 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_sequences_hold_the_pieces(spark):
    df = spark.createDataFrame([(i, "word " * (i * 37 % 90)) for i in range(60)], "doc_id long, text string").repartition(3)
    found, _ = _common.materialize(packing.pieces(df, capacity=50), "t")
    packed = packing.pack(found, 50)
    rows = packed.collect()
    check(rows, 50)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.assemble(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(len(x) for x in whole.values()) == 4 * packed.agg(F.sum("length")).first()[0]
