import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumix.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1600), min_size=1, max_size=6), min_size=1, max_size=3), st.integers(1, 9))
def test_round_trip_of_logical_streams(sizes, segments):
    streams = [(s, [(bytes([s + 1]) * n, sum(own[: i + 1])) for i, n in enumerate(own)]) for s, own in enumerate(sizes)]
    found = list(ogg.packets(list(ogg.pages(ogg.mux(streams, segments)))))
    for s, own in streams:
        mine = [p for p in found if p.serial == s]
        assert [p.data for p in mine] == [d for d, _ in own]
        assert all(p.complete for p in mine)
        assert all(p.granule in (ogg.NO_GRANULE, at) for p, (_, at) in zip(mine, own, strict=True))


@pytest.mark.parametrize("n", [64, 4096, 4160, 8192, 70_016])
def test_samples(n):
    payload = random.Random(n).randbytes(n)  # nothing that looks alike in another order
    back, feature = ogg.load_samples(ogg.store_samples(payload))
    assert back == payload
    assert f"seconds={n / 8000:.6f}" in feature and feature.startswith("streams=2;")


def test_damage_is_seen():
    media = bytearray(ogg.store_samples(b"x" * 5000))
    media[-10] ^= 1
    assert not all(p.good for p in ogg.pages(bytes(media)))
    with pytest.raises(ValueError):
        ogg.load_samples(bytes(media))


def test_a_wrong_order_of_times_is_seen():
    head = [(ogg.pcm_header(8000, 1, 100), 0), (b"c", 0)]
    gaps = [(0x0A, [*head, (b"a" * 100, 100), (b"c" * 100, 300)]), (0x0B, [*head, (b"b" * 100, 200)])]
    assert ogg.load_samples(ogg.mux(gaps, 255, alone=True))[0] == b"a" * 100 + b"b" * 100 + b"c" * 100
    with pytest.raises(ValueError):  # counted back over a gap
        ogg.load_samples(ogg.mux(gaps, 255))


def test_times_are_counted_back_from_the_page():
    head = (ogg.pcm_header(8000, 1, 100), 0)
    media = ogg.mux([(1, [head, (b"c", 0), (b"a" * 100, 100), (b"b" * 50, 150), (b"d" * 10, 160)])], 255)
    [s] = ogg.demultiplex(media)
    assert s.ends == [None, None, 100, 150, 160]


def test_operator_on_odd_rows(spark):
    media = ogg.store_samples(b"z" * 64)
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(), "x"), (3, bytearray(b"not ogg"), "x"), (None, bytearray(media), "x"), (4, bytearray(media), "x"), (4, bytearray(media), "x")], "k long, m binary, serial string")
    rows = sorted((r.k if r.k is not None else -1, r.serial, r.codec, r.payload_bytes, r.error is None) for r in ogg.read_streams(df, "k", "m").where("serial is not null").collect())
    assert rows == sorted([(-1, 10, "pcm", 64, True), (-1, 11, "pcm", 0, True)] + 2 * [(4, 10, "pcm", 64, True), (4, 11, "pcm", 0, True)])
    assert [r.k for r in ogg.read_streams(df, "k", "m").where("error is not null").collect()] == [3]
    got = ogg.read_packets(df, "k", "m").where("k = 4 and not is_header").collect()
    assert [bytes(r.data) for r in got] == [b"z" * 64] * 2 and got[0].end_s == 64 / 8000
    assert ogg.read_streams(df.limit(0), "k", "m").count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, None, "l"), (2, "", "l"), (3, "é" * 40, "l"), (4, "é" * 40, "l")], "doc_id long, text string, feature string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in ogg.op1_ogg(spark, str(tmp_path)).collect()}
    assert rows[1][1:] == rows[2][1:] and rows[3][1:] == rows[4][1:]
    assert (rows[1].n_bytes, rows[1].payload_bytes, rows[3].n_bytes, rows[3].payload_bytes) == (0, 64, 80, 128)
    assert rows[3].payload_sha256 == hashlib.sha256("é".encode() * 40 + bytes(48)).hexdigest()
    assert rows[1].tail_crc32 == zlib.crc32(bytes(64))


def slow_pages(media):
    """(serial, granule, flags, lacing values, body) of each page, by the format's description alone."""
    at, out = 0, []
    while at < len(media):
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        assert magic == b"OggS" and version == 0
        lacing = list(media[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(lacing)
        assert slow_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc
        assert number == sum(s == serial for s, *_ in out)
        out.append((serial, granule, flags, lacing, media[at + 27 + n : end]))
        at = end
    return out


def slow_packets(pages):
    """The packets of each logical stream: a lacing value under 255 ends one."""
    out, open_ = {}, {}
    for serial, _, _, lacing, body in pages:
        at = 0
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + body[at : at + size]
            at += size
            if size < 255:
                out.setdefault(serial, []).append(open_.pop(serial))
    assert not open_
    return out


def test_query_against_a_reader_of_its_own(spark, tmp_path):
    texts = [None, "", "a", "x" * 64, "é" * 700, "word and word " * 400, "".join(chr(32 + i * i % 90) for i in range(30_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in ogg.op1_ogg(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        media = ogg.store_samples(payload)
        pages = slow_pages(media)
        packets = slow_packets(pages)
        each = [p[2:] for _, p in sorted(packets.items())]  # after the header and the comment
        back = b"".join(each[k % 2][k // 2] for k in range(sum(map(len, each))))
        assert back == payload and all(len(p) == ogg.FRAMES for own in each for p in own[:-1])
        assert any(flags & ogg.CONTINUED for _, _, flags, _, _ in pages) == (len(payload) >= ogg.SEGMENTS * 255)
        assert max(g for _, g, *_ in pages) == len(payload)  # a granule is a sample
        feature = f"streams={len(packets)};pages={len(pages)};packets={sum(map(len, packets.values()))};seconds={len(payload) / 8000:.6f};mean={sum(payload) / len(payload):.4f}"
        want = (i, len(data), len(payload), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        assert tuple(rows[i]) == want
