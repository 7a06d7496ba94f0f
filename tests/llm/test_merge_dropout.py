import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumix.llm import merge_dropout as m


@functools.cache
def tools():
    import sentencepiece

    return m.Merger(m.model_path()), sentencepiece.SentencePieceProcessor(model_file=m.model_path())


TEXT = st.text(st.sampled_from("aeinorstlThe  \n\t,.é漢😀0192-_"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_without_dropout_it_is_the_library(text):
    merger, library = tools()
    assert merger.encode(text) == library.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | TEXT, st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 3))
def test_round_trip(text, dropout, seed):
    merger, _ = tools()
    ids = merger.encode(text, dropout, seed)
    assert merger.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("▁aeinorsth漢"), min_size=1, max_size=m.LONGEST), st.sampled_from([0.0, 0.1, 0.5, 0.9]), st.integers(0, 5))
def test_agenda_and_numpy_agree(word, dropout, n):
    merger, _ = tools()
    keys, noted, done = m.keys_of(b"text", n + 1, 7), [], []
    got, starts = merger.segment([word], np.zeros(n + 1, np.int64), keys, dropout, noted)
    each = [merger.agenda(word, int(k), dropout, done) for k in keys]
    assert [got[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == each
    assert sorted(p for _, places in noted for p in places.tolist()) == sorted(done)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_occurrences_equal_the_agenda_of_each(texts, dropout):
    merger, _ = tools()
    index, want, plain, refs, keys = m._Index(), [], [], [], []
    for t in texts:
        refs.append(merger.word_refs(t, index) if t else np.zeros(0, np.int64))
        keys.append(m.keys_of(t.encode(), len(refs[-1]), 3))
        for w, k in zip(merger.words(t), keys[-1], strict=True):
            want.append(merger.agenda(w, int(k), dropout))
            plain.append(len(merger.agenda(w, 0, 0.0)))
    ids, bounds, n = merger.occurrences(list(map(merger.marked, index)), np.concatenate(refs), np.concatenate(keys), dropout)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want and n.tolist() == plain


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab  \n▁é"), max_size=30))
def test_marked_words(text):
    merger, _ = tools()
    index = m._Index()
    refs = merger.word_refs(text, index) if text else []
    names = list(index)
    assert [merger.marked(names[i]) for i in refs] == merger.words(text)


def test_seeds_texts_and_places_vary_the_segmentation():
    merger, _ = tools()
    text = "the international standardization of interoperability considerations " * 3
    seen = {tuple(merger.encode(text + str(k), 0.3, seed)) for seed in range(4) for k in range(4)}
    assert len(seen) == 16 and merger.encode(text, 0.3, 1) == merger.encode(text, 0.3, 1)
    one = merger.segment(["▁standardization"], np.zeros(50, np.int64), m.keys_of(b"t", 50, 1), 0.3)
    assert len({tuple(one[0][a:b]) for a, b in zip(one[1][:-1], one[1][1:], strict=True)}) > 10
    assert len(merger.encode(text, 0.3)) > len(merger.encode(text))
    assert merger.encode("ab", 1.0) == merger.characters("▁ab")


def test_share_of_skipped_merges_is_the_dropout_over_places_and_over_texts():
    merger, _ = tools()
    for keys in (m.keys_of(b"some text", 20_000, 5), np.concatenate([m.keys_of(str(i).encode(), 1, 5) for i in range(20_000)])):
        for p in (0.1, 0.5):
            # A word with one candidate merge, and one whose second merge needs its first.
            one = np.diff(merger.segment(["th"], np.zeros(len(keys), np.int64), keys, p)[1])
            assert (one == 2).mean() == pytest.approx(p, abs=0.015)
            assert abs(np.corrcoef(one[1:], one[:-1])[0, 1]) < 0.03


def test_operator(spark, tmp_path):
    texts = [None, "", "a  b\n c", "literal ▁ mark", "x" * 5000, "word " * 40_000, "é" * 70, "a  b\n c"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "n", "z"), (2, texts[2], "z")], "doc_id long, text string, ids string")
    enc = m.encode(df.drop("ids").withColumnRenamed("text", "text"), dropout=0.4)
    rows = {r.doc_id: r for r in enc.collect()}
    assert all(r.lossless for r in rows.values()) and rows[0].n_tokens == rows[1].n_tokens == 0
    assert bytes(rows[2].ids) == bytes(rows[7].ids) and enc.count() == len(texts) + 2
    back = {r.doc_id: r.text for r in m.decode(enc).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert m.op7_merge_dropout(spark, str(tmp_path)).where("lossless and n_plain is not null").count() == len(texts) + 2
    assert m.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.encode(df, dropout=1.5)


def test_query_equals_the_agenda_of_every_word(spark, tmp_path):
    merger, _ = tools()
    texts = ["the international standardization of words and the words of standardization", "a  b\n c", "ü 漢 😀 ▁", "x" * 100, "the same\nthe same", "", None, "the same\nthe same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in m.op7_merge_dropout(spark, str(tmp_path)).collect()}
    for i, text in enumerate(t or "" for t in texts):
        words = merger.words(text)
        keys = m.keys_of(text.encode(), len(words), m.SEED)
        ids = [x for w, k in zip(words, keys, strict=True) for x in merger.agenda(w, int(k), m.DROPOUT)]
        assert (got[i].n_tokens, got[i].n_plain, got[i].lossless) == (len(ids), len(merger.encode(text)), True)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and merger.decode(ids) == text
