"""Ogg media columns: pages, packets, logical streams and timestamps.

``mux`` writes an Ogg physical stream; ``pages`` checks each page's checksum; ``packets``
demultiplexes logical streams and reassembles packets from lacing values; ``packet_times``
derives times from granule positions. ``read_streams`` and ``read_packets`` apply them to
a binary column of a DataFrame.

Defined results: a null or empty payload has no pages, so no rows come of it, and bytes that
are not Ogg give one row with ``error``. A page whose checksum fails is counted and its body is
dropped, which makes the packets on it incomplete; incomplete packets are reported, not
returned. Only the id and payload columns are read, so other columns can't clash. Everything is
row-local: no shuffle, and one row's payload at a time is held in memory.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumix.llm import _common

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

# The checksum's polynomial is zlib's, taken without reflection: reflect the bytes going in and
# the register coming out, and zlib's C loop computes it.
_REFLECT = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 as Ogg has it: polynomial 04C11DB7, start 0, neither reflected nor inverted."""
    register = zlib.crc32(data.translate(_REFLECT), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_REFLECT), "big")


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    good: bool


class Packet(NamedTuple):
    serial: int
    number: int
    data: bytes
    complete: bool
    granule: int  # of its page, if it is the last to end there, else NO_GRANULE


def page_bytes(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    """One page with its checksum."""
    head = CAPTURE + struct.pack("<BBqII", 0, flags, granule, serial, sequence)
    rest = bytes([len(lacing)]) + lacing + body
    return head + struct.pack("<I", checksum(head + b"\0\0\0\0" + rest)) + rest


def _stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int, alone: bool) -> Iterator[tuple[int, bytes]]:
    """(granule of the last packet so far, page) for one logical stream; its first packet (all, if ``alone``) ends a page."""
    sequence, lacing, body = 0, bytearray(), bytearray()
    granule, flags, reached = NO_GRANULE, FIRST, 0
    for i, (data, at) in enumerate(packets):
        left = len(data)
        for value in [255] * (left // 255) + [left % 255]:
            if len(lacing) == segments:
                yield reached, page_bytes(flags, granule, serial, sequence, bytes(lacing), bytes(body))
                sequence, flags, granule = sequence + 1, CONTINUED if left < len(data) else 0, NO_GRANULE
                lacing, body = bytearray(), bytearray()
            lacing.append(value)
            body += data[len(data) - left : len(data) - left + value]
            left -= value
        granule = reached = at
        if (i == 0 or alone) and i < len(packets) - 1:
            yield reached, page_bytes(flags, granule, serial, sequence, bytes(lacing), bytes(body))
            sequence, flags, granule, lacing, body = sequence + 1, 0, NO_GRANULE, bytearray(), bytearray()
    yield reached, page_bytes(flags | LAST, granule, serial, sequence, bytes(lacing), bytes(body))


def mux(streams: list[tuple[int, list[tuple[bytes, int]]]], segments: int = 64, alone: bool = False) -> bytes:
    """A physical stream of logical ones, each (serial, [(packet, granule at its end)]).

    The first pages come first, then all pages in the order of their granules.
    ``segments``: lacing values on a page, 255 at most. ``alone``: every packet ends a page, so that
    its granule is written; needed where a stream has gaps, over which times can't be counted back.
    """
    each = [_stream_pages(serial, packets, segments, alone) for serial, packets in streams if packets]
    first = [next(pages)[1] for pages in each]
    rest = heapq.merge(*([(at, k, page) for at, page in pages] for k, pages in enumerate(each)), key=lambda x: x[:2])
    return b"".join(first) + b"".join(page for _, _, page in rest)


def pages(data: bytes) -> Iterator[Page]:
    """All pages; bytes between pages are skipped, a page cut short ends the stream."""
    at = data.find(CAPTURE)
    while at >= 0:
        if at + 27 > len(data):
            return
        version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if version != 0 or len(lacing) < n or end > len(data):
            at = data.find(CAPTURE, at + 4)
            continue
        good = checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
        yield Page(flags, granule, serial, sequence, lacing, data[start:end], good)
        # After a failed checksum the lacing may be wrong too: look for the next page inside.
        at = data.find(CAPTURE, end if good else at + 4)


def packets(found: list[Page]) -> Iterator[Packet]:
    """Packets of each logical stream, in the order in which they end."""
    parts: dict[int, list[bytes]] = {}
    whole: dict[int, bool] = {}
    due: dict[int, int] = {}
    number: dict[int, int] = defaultdict(int)

    def ended(serial: int, granule: int) -> Packet:
        number[serial] += 1
        return Packet(serial, number[serial] - 1, b"".join(parts.pop(serial)), whole.pop(serial), granule)

    for page in found:
        if not page.good:
            continue
        serial = page.serial
        gap = page.sequence != due.get(serial, page.sequence if page.flags & FIRST else -1)
        due[serial] = page.sequence + 1
        if serial in parts and (gap or not page.flags & CONTINUED):
            whole[serial] = False  # its end was on a page that is missing
            yield ended(serial, NO_GRANULE)
        if serial not in parts and page.flags & CONTINUED:
            parts[serial], whole[serial] = [], False  # its start was
        last = max((i for i, value in enumerate(page.lacing) if value < 255), default=-1)
        at = 0
        for i, value in enumerate(page.lacing):
            parts.setdefault(serial, []).append(page.body[at : at + value])
            whole.setdefault(serial, True)
            at += value
            if value < 255:
                yield ended(serial, page.granule if i == last else NO_GRANULE)
    for serial in list(parts):
        whole[serial] = False
        yield ended(serial, NO_GRANULE)


# Uncompressed audio in Ogg: the identification packet's fields, most significant byte first.
_PCM_ID = b"PCM     "
_PCM_FIELDS = ">8sHHIIBBHI"
PCM_U8 = 1


def pcm_header(rate: int, channels: int, frames: int) -> bytes:
    """Identification packet for unsigned 8-bit samples."""
    return struct.pack(_PCM_FIELDS, _PCM_ID, 0, 0, PCM_U8, rate, 8, channels, frames, 0)


def codec(first: bytes) -> tuple[str, int, int, int]:
    """Name, granules a second (0: unknown), bytes of a frame (0: unknown) and header packets by a stream's first packet."""
    if first[:8] == _PCM_ID and len(first) >= struct.calcsize(_PCM_FIELDS):
        _, _, _, _, rate, bits, channels, _, extra = struct.unpack_from(_PCM_FIELDS, first)
        return "pcm", rate, channels * ((bits + 7) // 8), 2 + extra
    if first[:7] == b"\x01vorbis" and len(first) >= 16:
        return "vorbis", struct.unpack_from("<I", first, 12)[0], 0, 3
    if first[:8] == b"OpusHead":
        return "opus", 48000, 0, 2
    if first[:5] == b"\x7fFLAC" and len(first) >= 30:
        return "flac", int.from_bytes(first[27:30], "big") >> 4, 0, 1 + int.from_bytes(first[7:9], "big")
    if first[:8] == b"Speex   " and len(first) >= 40:
        return "speex", struct.unpack_from("<I", first, 36)[0], 0, 2
    return "unknown", 0, 0, 1


def packet_times(stream: list[Packet], frame: int) -> list[int | None]:
    """Granule at each packet's end.

    A page gives that of the last packet ending on it. For codecs with frames of a fixed size
    those before it are counted back from there; else they are null.
    """
    ends: list[int | None] = [p.granule if p.granule != NO_GRANULE else None for p in stream]
    if frame:
        for i in range(len(stream) - 2, -1, -1):
            after = ends[i + 1]
            if ends[i] is None and after is not None and stream[i + 1].complete:
                ends[i] = after - len(stream[i + 1].data) // frame
    return ends


class Stream(NamedTuple):
    serial: int
    codec: str
    rate: int
    frame: int
    headers: int
    pages: int
    bad_pages: int
    packets: list[Packet]
    ends: list[int | None]


def demultiplex(data: bytes) -> list[Stream]:
    """The logical streams in the order in which they begin, with their packets and granules."""
    found = list(pages(data))
    by: dict[int, list[Packet]] = {}
    for p in packets(found):
        by.setdefault(p.serial, []).append(p)
    out = []
    for serial in dict.fromkeys(p.serial for p in found if p.good):
        own = by.get(serial, [])
        name, rate, frame, headers = codec(own[0].data) if own and own[0].complete else ("unknown", 0, 0, 1)
        ends = [None] * min(headers, len(own)) + packet_times(own[headers:], frame)
        good = sum(p.serial == serial and p.good for p in found)
        out.append(Stream(serial, name, rate, frame, headers, good, sum(p.serial == serial and not p.good for p in found), own, ends))
    return out


STREAM_SCHEMA = "serial long, codec string, pages long, bad_pages long, packets long, incomplete_packets long, payload_bytes long, last_granule long, seconds double, error string"
PACKET_SCHEMA = "serial long, packet long, is_header boolean, end_granule long, end_s double, data binary"


def _stream_rows(data: bytes) -> list[dict]:
    streams = demultiplex(data)
    if not streams:
        return [dict.fromkeys(("serial", "codec", "last_granule", "seconds")) | {"pages": 0, "bad_pages": 0, "packets": 0, "incomplete_packets": 0, "payload_bytes": 0, "error": "no Ogg page with a right checksum"}]
    rows = []
    for s in streams:
        whole = [p for p in s.packets if p.complete]
        last = max((e for e in s.ends if e is not None), default=None)
        rows.append({"serial": s.serial, "codec": s.codec, "pages": s.pages, "bad_pages": s.bad_pages, "packets": len(whole), "incomplete_packets": len(s.packets) - len(whole), "payload_bytes": sum(len(p.data) for p in whole[s.headers :]), "last_granule": last, "seconds": last / s.rate if s.rate and last is not None else None, "error": None})
    return rows


def _packet_rows(data: bytes) -> list[dict]:
    return [
        {"serial": s.serial, "packet": p.number, "is_header": i < s.headers, "end_granule": e, "end_s": e / s.rate if s.rate and e is not None else None, "data": p.data}
        for s in demultiplex(data)
        for i, (p, e) in enumerate(zip(s.packets, s.ends, strict=True))
        if p.complete
    ]


def _apply(df: DataFrame, id_column: str, payload: str, rows, schema: str) -> DataFrame:
    _common.ship(df.sparkSession)
    own = df.select(F.col(id_column).alias("id"), F.col(payload).cast("binary").alias("data")).where("length(data) > 0")
    out = own.select("id").schema.fields[0].dataType.simpleString()

    def run(batches):
        for batch in _common.slices(batches, "data"):
            made = [{"id": i} | row for i, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True) for row in rows(data)]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = df.sparkSession.createDataFrame([], f"id {out}, {schema}").schema
    arrow = to_arrow_schema(spark_schema)
    return own.mapInArrow(run, spark_schema).withColumnRenamed("id", id_column)


def read_streams(df: DataFrame, id_column: str, payload: str) -> DataFrame:
    """A row for each logical stream of each payload, with what its pages and granules say."""
    return _apply(df, id_column, payload, _stream_rows, STREAM_SCHEMA)


def read_packets(df: DataFrame, id_column: str, payload: str) -> DataFrame:
    """A row for each complete packet of each logical stream of each payload, with its time."""
    return _apply(df, id_column, payload, _packet_rows, PACKET_SCHEMA)


RATE, FRAMES, SEGMENTS = 8000, 4096, 12
SERIALS = (0x0A, 0x0B)


def store_samples(payload: bytes) -> bytes:
    """``payload`` as unsigned 8-bit mono samples, its packets dealt in turn to two logical streams.

    So each stream has a gap after every packet, and every packet's granule is written. Packets of
    more than ``SEGMENTS`` lacing values go on on the next page.
    """
    comment = struct.pack("<I", 8) + b"vellumix" + struct.pack("<I", 0)
    streams: list[tuple[int, list[tuple[bytes, int]]]] = [(s, [(pcm_header(RATE, 1, FRAMES), 0), (comment, 0)]) for s in SERIALS]
    for i, at in enumerate(range(0, len(payload), FRAMES)):
        part = payload[at : at + FRAMES]
        streams[i % len(SERIALS)][1].append((part, at + len(part)))
    return mux(streams, SEGMENTS, alone=True)


def load_samples(media: bytes) -> tuple[bytes, str]:
    """The samples of all PCM streams in the order of their times, and a line of features.

    Raises ValueError where a page, a packet or a stretch of time is missing.
    """
    streams = demultiplex(media)
    timed = sorted((e, p.data) for s in streams for p, e in zip(s.packets[s.headers :], s.ends[s.headers :], strict=True) if e is not None)
    payload = b"".join(data for _, data in timed)
    ends = np.cumsum([len(data) for _, data in timed]).tolist()
    if any(s.bad_pages for s in streams) or not all(p.complete for s in streams for p in s.packets) or [e for e, _ in timed] != ends:
        raise ValueError("the stored stream is damaged")
    end = timed[-1][0]
    mean = sum(payload) / len(payload)
    feature = f"streams={len(streams)};pages={sum(s.pages for s in streams)};packets={sum(len(s.packets) for s in streams)};seconds={end / RATE:.6f};mean={mean:.4f}"
    return payload, feature


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    for batch in _common.slices(batches, "data"):
        rows = []
        for text in batch.column("data").to_pylist():
            media = store_samples(text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text)))
            payload, feature = load_samples(media)
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])


def op1_ogg(spark, sf_dir: str) -> DataFrame:
    """Each document's text through an Ogg stream and back: digests of payload and stored form, and features."""
    _common.ship(spark)
    docs = _common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), _common.text_bytes().alias("data"))
    return docs.mapInArrow(_features, FEATURE_SCHEMA)
