import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_quality import slow
from vellumix.llm import order_minhash, packing

GOOD = "the sea is wide and ships go by in the evening light while people watch from shore".split()


CLASHES = ("score", "predicted", "kept", "n_words", "n_removed", "n_lines", "_id", "_own", "_text_hash", "row", "digest", "id", "data", "_fence", "length")


def tables(path, spark):
    rng = random.Random(8)
    names = [f"name{i}" for i in range(2000)]
    line = lambda: " ".join(rng.choices(GOOD, k=9) + rng.choices(names, k=6)) + "."
    docs = [[line() for _ in range(rng.randint(3, 9))] for _ in range(100)]
    texts = ["\n".join(x) for x in docs]
    texts += [texts[i] for i in (3, 3, 9)]  # copies
    texts += [texts[i].replace(docs[i][0], line()) for i in (5, 6)]  # a first line of their own
    texts += ["\n".join([*docs[20], line(), line()]), "\n".join([line(), line(), *docs[21]])]
    short = " ".join(rng.choices(names, k=60)) + "."
    texts += [short, short.replace(short.split()[30], "other")]  # near copies of one line
    texts += ["\n".join([docs[50][0], "Home | About | Contact | Help", *docs[50][1:]]), docs[51][0] + "\nread more"]
    bad = [" ".join(w + "$$$" for w in rng.choices(GOOD, k=60)) for _ in range(40)]
    loud = ["!! ".join(w.upper() for w in rng.choices(GOOD, k=60)) + "!!" for _ in range(3)]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate([*texts, *bad, *loud, None, ""])]
    # Columns called like those of the operators' own.
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.withColumns({c: F.col("doc_id").cast("string") for c in CLASHES}).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < len(texts)), 0) for i in range(len(texts) + len(bad))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, len(texts)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, good = tables(path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {"documents": docs.collect()}
    columns = docs.dtypes
    for name, f in corpus_pipeline.STAGES:
        made = f(spark, docs, path)
        if name != "best_fit_packing":
            assert made.dtypes == columns
            assert made.where(" OR ".join(f"NOT {c} <=> CAST(doc_id AS STRING)" for c in CLASHES)).count() == 0
        made.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs.collect()
    return out, good, path


def test_the_classifier_and_the_rules(stages):
    out, good, _ = stages
    kept = {r.doc_id for r in out["quality_classifier"]}
    assert set(range(good)) <= kept and not kept & set(range(good, good + 40))
    ruled = {r.doc_id: r for r in out["quality_rules"]}
    before = {r.doc_id: r for r in out["quality_classifier"]}
    assert set(ruled) == {i for i, r in before.items() if not slow(r.text)[-1] and not (r.text and "!!" in r.text)}
    changed = {i for i, r in ruled.items() if r.text != before[i].text}
    assert len(changed) == 2 and all(r.n_chars == len(r.text) and "Home" not in r.text and "read more" not in r.text for r in ruled.values())


def test_line_dedup_keeps_a_copy_of_every_line(stages):
    out, _, _ = stages
    before = {r.doc_id: r.text.split("\n") for r in out["quality_rules"]}
    after = {r.doc_id: r.text.split("\n") for r in out["line_dedup"]}
    assert {x for v in before.values() for x in v} == {x for v in after.values() for x in v}
    assert set(before) - set(after) == {100, 101, 102, 109}  # whole copies, one of them without its menu line
    first = {}
    for i in sorted(before):
        for x in before[i]:
            first.setdefault(x, i)
    for i, lines in before.items():
        gone = [x for x in lines if x not in after.get(i, [])]
        assert all(first[x] < i for x in gone)
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"])


def test_near_dedup_keeps_one_of_each_class(stages):
    out, _, _ = stages
    rows = sorted((r.doc_id, r.text) for r in out["line_dedup"])
    own = [order_minhash.parsed(t.encode()) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] == rows[b][1] or order_minhash.linked(own[a], own[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert sorted((r.doc_id, r.text) for r in out["near_dedup"]) == [rows[i] for i in sorted(set(label))]
    assert len(out["near_dedup"]) < len(out["line_dedup"])


def test_packing_holds_every_document(stages):
    out, _, _ = stages
    encoder = packing.WordIds(packing.tokenizer_path()).tokenizer
    ids = {r.doc_id: encoder.encode(r.text, add_special_tokens=False).ids + [1] for r in out["near_dedup"]}
    by = defaultdict(list)
    for r in out["best_fit_packing"]:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out["best_fit_packing"]) == sum(map(len, ids.values()))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run(spark, stages):
    out, _, path = stages
    got = corpus_pipeline.run(spark, path)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, out["best_fit_packing"]))
