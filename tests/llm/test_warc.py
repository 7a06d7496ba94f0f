import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from vellumix.llm import warc

DATE = "2020-02-02T00:00:00Z"
ROWS = [
    (1, "http://a/1", "<p>x</p>", 0),
    (2, "http://a/2", "<p>x</p>", 0),
    (3, "http://a/3", "y\r\n\r\nWARC/1.1\r\n", 0),
    (4, None, None, 0),
    (5, "http://a/5", "", 0),
    (6, "http://a/ö", "ö" * 100_000, 0),
    (7, "http://a/7", "<p>x</p>", 0),
    (7, "http://a/7", "<p>x</p>", 0),
    (8, "http://a/8", " ", 0),
    (None, "http://a/n", "<p>x</p>", 0),
]


def brute(rows, least=0):
    by = defaultdict(list)
    for i, _, html, _ in rows:
        by[html or ""].append(-1 if i is None else i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        top = max(by[html or ""])
        again = len(data) >= least and top != (-1 if i is None else i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_write_read_resolve(spark, tmp_path, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, record_type int").repartition(3)
    path = f"{tmp_path}/out"
    warc.write_archives(df, path, min_bytes=least)
    found = warc.read_archives(spark, path)
    got = [tuple(r) for r in warc.resolve(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(ROWS, least)
    assert {bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()} == {h or "" for _, _, h, _ in ROWS}
    assert found.where("record_type = 'revisit' and payload is not null").count() == 0
    files = [p for p in Path(path).glob("part-*") if p.stat().st_size]
    assert files
    for p in files:
        own = list(warc.records(io.BytesIO(gzip.decompress(p.read_bytes()))))
        assert own[0].head["warc-type"] == "warcinfo" and own[0].head["warc-date"][:2] == "20"
        assert all(r.head["warc-profile"] == warc.PROFILE for r in own if r.head["warc-type"] == "revisit")


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/out")
    assert warc.resolve(warc.read_archives(spark, f"{tmp_path}/out")).count() == 0


def test_damage_is_seen():
    good = warc.info_record(DATE) + b"\r\n\r\n" + warc.record(1, "u", b"abc", None, DATE) + b"\r\n\r\n"
    assert len(list(warc.records(io.BytesIO(good)))) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-7])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"x" + good)))


def test_a_revisit_without_its_original_resolves_to_null(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string, x int")
    warc.write_archives(df, f"{tmp_path}/out")
    rest = warc.read_archives(spark, f"{tmp_path}/out").where("record_type = 'revisit'")
    [r] = warc.resolve(rest).collect()
    assert (r.page_id, r.payload_bytes, r.refers_to) == (1, None, None)


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string, x int").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in warc.op5_warc(spark, str(tmp_path)).collect()), key=repr) == brute(ROWS)


def test_large_records_make_bounded_files_of_independent_members(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", f"{i} " + rng.randbytes(1_000_000).hex(), 0) for i in range(12)] + ROWS
    df = spark.createDataFrame(rows, "page_id long, url string, html string, x int").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        warc.write_archives(df, f"{tmp_path}/out", file_bytes=8 << 20)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = [p for p in Path(f"{tmp_path}/out").glob("part-*") if p.stat().st_size]
    seen = 0
    for p in files:
        data, sizes = p.read_bytes(), []
        while data:  # every member by itself
            z = zlib.decompressobj(31)
            plain = z.decompress(data)
            sizes.append(len(plain))
            own = list(warc.records(io.BytesIO(plain)))
            assert len(own) == (1 if plain else 0)
            seen += sum(r.head["warc-type"] != "warcinfo" for r in own)
            data = z.unused_data
        assert sum(sizes) - max(sizes) <= (8 << 20) + 10_000
        assert next(warc.records(io.BytesIO(gzip.decompress(p.read_bytes())))).head["warc-type"] == "warcinfo"
    assert seen == len(rows)
    # All files streamed, as those of other tools beyond ``LARGE`` are.
    got = [tuple(r) for r in warc.resolve(warc.read_archives(spark, f"{tmp_path}/out", large=0)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_files_roll_at_their_size():
    rows = list(warc.rolled((bytes([i]) * 100 for i in range(40)), DATE, file_bytes=1600))
    assert len(rows) == 40
    assert [k for k, r in enumerate(rows) if gzip.decompress(r).startswith(b"WARC")] == [0, 16, 32]
