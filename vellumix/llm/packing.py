"""Best-fit packing of token pieces into sequences by minimum bin slack.

A plan needs only how many pieces have each length: at most ``capacity`` numbers, whatever the
corpus. On the driver, bin after bin takes the longest length left and, by subset sums held in the
bits of an integer, the fullest combination of the lengths still available; the combination is
taken as often as the counts allow, so the plan has a few thousand patterns for any corpus.

Pieces find their places without a global sort: each task numbers its pieces of a length, the
tasks' counts (not the pieces) are summed over tasks, and the rank so found says in which pattern,
bin and place a piece goes. One length may hold any share of all pieces.

Defined results: a null text is an empty one and gives one piece with the closing id alone;
repeated rows are packed each by itself; ties in length go by the tasks' order of rows, and any
such order packs as well; an empty table packs into nothing. Pieces longer than the capacity are
refused.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumix.llm import _common

CAPACITY, CLOSING_ID = 4096, 1
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")


def tokenizer_path() -> str:
    """The default vocabulary's file; ``pieces`` takes any other."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """A text's ids as little-endian 32-bit bytes, through the ids of its words.

    For vocabularies whose pre-tokenizer never joins text across a space or line feed: then a
    text's ids are its words' ids one after another, and a word is encoded once a batch.
    Remembers a bounded number of words, from one task of a worker to the next.
    """

    MOST, TOGETHER = 2_000_000, 20_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        """This worker's encoder for a file."""
        return _common.KEPT.get(path) or _common.KEPT.setdefault(path, cls(path))

    def encode(self, texts: list[str]) -> list[bytes]:
        each = [t.replace("\n", " ").split(" ") for t in texts]
        used = set().union(*each)
        missing = used.difference(self.young)
        self.young.update((w, self.old[w]) for w in missing.intersection(self.old))
        new = list(missing.difference(self.young))
        for at in range(0, len(new), self.TOGETHER):
            part = new[at : at + self.TOGETHER]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.young[w] = array("I", e.ids).tobytes()
        out = [b"".join(map(self.young.__getitem__, words)) for words in each]
        if len(self.young) > self.MOST // 2:
            self.old, self.young = self.young, {"": b""}  # what isn't used again soon goes
        return out


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long, ids binary"


def pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, keep_ids: bool = True) -> DataFrame:
    """Each text's ids and the closing id, cut into pieces of ``capacity`` tokens at most.

    ``task`` and ``number`` give a piece its place among those of its length.
    """
    _common.ship(docs.sparkSession)
    path = path or tokenizer_path()
    names = [x.split()[0] for x in _PIECES.split(", ")]
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches):
        encoder, number = WordIds.of(path), Counter()
        for batch in _common.slices(batches, "data", 3 << 20, keep=True):
            rows = []
            [task] = set(batch.column("task").to_pylist())
            ids = encoder.encode([t.decode(errors="replace") for t in batch.column("data").to_pylist()])
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                own += closing
                for i, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(part), task, number[n], part if keep_ids else None))
                    number[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), _common.text_bytes(text).alias("data"), F.spark_partition_id().alias("task")).mapInArrow(run, _PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of which lengths fill ``room`` best, by subset sums; longer lengths are tried first."""
    reach, full = 1, (1 << (room + 1)) - 1
    steps = []  # (length, copies, what was reachable before)
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room:
            copies = min(copies, left)
            after = (reach | reach << length * copies) & full
            if after != reach:
                steps.append((length, copies, reach))
                reach = after
            left -= copies
            copies *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += copies
            total -= length * copies
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (lengths with their numbers in a bin) and how many bins each has."""
    left = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = Counter(fullest({x: n for x, n in left.items() if n}, capacity - longest))
        left[longest] += 1
        pattern[longest] += 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((dict(pattern), times))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in a bin, first bin, offset of the first) in order of rank."""
    taken, out, bins = Counter(), {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            out.setdefault(length, []).append((taken[length], n, bins, offset))
            taken[length] += n * times
            offset += length * n
        bins += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length``, ``task`` and ``number``.

    ``found`` is read twice, so it should be a written table.
    """
    by_task = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity bounds it
    table = places(plan(counts, capacity))
    before = by_task.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    ranked = found.join(before, ["length", "task"]).withColumn("rank", F.col("first") + F.col("number")).drop("first", "task", "number")
    names = [*ranked.columns, "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own, rows = length == x, table[int(x)]
                first, n, bin_, at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                sequence[own] = bin_ + (rank[own] - first) // n
                offset[own] = at + (rank[own] - first) % n * x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=names)

    schema = ", ".join(f"{c} {k}" for c, k in ranked.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema).drop("rank")


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences: (sequence_id, length, ids as little-endian 32-bit bytes). A group has ``capacity`` tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """A row for each piece of each document, with its sequence and place there."""
    found, _ = _common.materialize(pieces(docs, keep_ids=False).drop("ids"), "pieces")
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(_common.read(spark, sf_dir, "documents"))
