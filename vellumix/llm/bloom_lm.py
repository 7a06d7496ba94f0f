"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Texts are tokenized once, into slices of some documents in the shared folder: what the slice's
different words hash to, and each token's place among them.

Counting: each task sums the words and the n-grams of two words (to ``order``) of its slices and
sends them, as arrays cut by hash range, to the range's segment; a segment sums what it gets.
Segments are ranges of a 64-bit hash, so frequent words don't make one larger. Their number is that
of the tokens over ``SEGMENT_TOKENS``, whatever the partitions are; only ranges that hold something
are sent, so there are never more rows than n-grams.

Filter: a count is kept as its level, exact for small counts and in 24 steps an octave beyond; an
n-gram with level q is inserted as (n-gram, 1) .. (n-gram, q), so probing one level after another
until one is missing reads the level back. Bits lie in 64-bit cells: a probe reads one cell and
asks for ``BITS`` bits in it. Level 1 is asked in several cells, more in a larger vocabulary: at most
``FALSE_GRAMS`` false n-grams are expected among all words after a context; higher levels in ``HIGHER``,
so that one n-gram in a thousand has a level too high. A segment's table has a cell for ``LOAD`` probes,
so the whole filter grows with the corpus, and no level is ever cut.

Probing: executors get the model in parts of whole segments, of ``part_bytes`` together (or one
segment): words with exact counts and filter. A slice asks each part once for what lies in its ranges
of the slice's different words and n-grams; questions are written by part, so each part reads its own
only, and the work grows with the corpus alone. The answers return to their slices by a shuffle. All
this is the same with one part and with many, so scores depend on neither parts nor partitions.

Probability: words by their exact counts with one added; an n-gram's estimated count, at most that of
its context and of its last n-1 words, is smoothed towards the shorter one's probability with weight
``PRIORS``, over the context's count, that weight, and the false count that the filter is expected to
add. So probabilities after a context sum to one, but for the chance of that false count.

Defined results: a null text is an empty one, whose only token is the end; a null id counts as
the text "" where rows are chosen by id; repeated rows are counted and scored each by itself;
without training tokens every probability is that of a lone unknown token. Words are known by 64-bit
hashes: two of a billion different ones share theirs with a chance of 3 %, and then their counts; n-grams
by 56 bits, of a billion different ones some seven do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumix.llm import _common

END = b"\n"  # no word holds it; it ends a text and stands before its first word
ORDER = 2
PRIORS = {2: 256.0}  # of longer n-grams: PRIOR
PRIOR = 32.0
FALSE_GRAMS = 2.0  # expected at most among a vocabulary's words after one context; small beside PRIORS
BITS, HIGHER, LOAD = 4, 2, 8.0
STEPS_AN_OCTAVE = 24
SEGMENT_TOKENS, PART_BYTES = 4_000_000, 96 << 20
FLUSH = 5_000_000  # tokens counted at a time in a task
SLICE = 10 << 20  # bytes of a slice's texts
#: N-grams are known by 56 bits, whose steps in sorted order take fewer bytes.
GRAM_BITS = np.uint64(0xFFFFFFFFFFFFFF00)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its context and its last word."""
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*text.lower().split(), END]


class Slice:
    """Tokens of some texts, one after another; ``bounds`` cut them into texts.

    ``vocabulary`` has the hashes of the different tokens, the end's first; ``ids`` each token's place in it.
    """

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.vocabulary, self.ids, self.bounds = vocabulary, ids, bounds

    @classmethod
    def of(cls, texts: list[bytes]) -> Slice:
        each = [tokens(t) for t in texts]
        bounds = np.cumsum([0] + [len(x) for x in each])
        index = _Index({END: 0})
        ids = np.fromiter((i for x in each for i in map(index.__getitem__, x)), np.int32, int(bounds[-1]))
        return cls(np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index)), ids, bounds)

    @property
    def words(self) -> np.ndarray:
        return self.vocabulary[self.ids]

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's value at the token before it, ``first`` at a text's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.bounds[:-1]] = first
        return out

    def grams(self, order: int) -> list[np.ndarray]:
        """The hashes of the n-grams of 2 .. ``order`` words that end at each token."""
        words = self.words
        out, last = [], words
        for k in range(2, order + 1):
            last = gram_hashes(self.before(last, self.vocabulary[0] + np.uint64(k - 2)), words)
            out.append(last & GRAM_BITS)
        return out


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: zeros together, so that they compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _values(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _sorted(x: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _starts(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment's range begins among sorted hashes, and their number."""
    lows = np.arange(segments, dtype=np.uint64) << np.uint64(64 - segments.bit_length() + 1) if segments > 1 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(hashes, lows), len(hashes))


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash: its leading bits (``segments`` is a power of two)."""
    return (hashes >> np.uint64(64 - segments.bit_length() + 1)).astype(np.int64) if segments > 1 else np.zeros(len(hashes), np.int64)


_PART = "segment int, words binary, word_counts binary, once binary, grams binary, gram_counts binary"
_MODEL = "segment int, n long, v long, words binary, word_counts binary, repeats int, chance double, filter binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _flush(words: list, counts: list, grams: list, segments: int) -> pa.RecordBatch:
    w, wn = _summed(np.concatenate(words), np.concatenate(counts))
    g, gn = np.unique(np.concatenate(grams), return_counts=True)
    once = gn == 1
    g1, g2, gn = g[once], g[~once], gn[~once].astype(np.int64)
    cut = [_starts(x, segments) for x in (w, g1, g2)]
    some = np.flatnonzero(sum(np.diff(c) for c in cut))
    own = lambda how, x, c, s: how(x[c[s] : c[s + 1]])
    rows = [(int(s), own(_sorted, w, cut[0], s), own(_planes, wn, cut[0], s), own(_sorted, g1, cut[1], s), own(_sorted, g2, cut[2], s), own(_planes, gn, cut[2], s)) for s in some]
    return _batch(rows, _PART)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(counts, first)


def _level_starts() -> np.ndarray:
    """The smallest count of each level from 1 on."""
    out = [1]
    while out[-1] < 1 << 44:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 2 ** (1 / STEPS_AN_OCTAVE))))
    return np.array(out, np.int64)


LEVELS = _level_starts()
COUNTS = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1:]])


def levels(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 has 0."""
    return np.searchsorted(LEVELS, counts, "right")


def count_at(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    return COUNTS[level]


def _probe(hashes: np.ndarray, level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """For the i-th cell of (n-gram, level): 32 bits to choose it by, and the bits asked in it."""
    key = _mix(hashes + np.uint64(((level << 8) + i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    return key >> np.uint64(32), key


def _cell(chosen: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (chosen * cells) >> np.uint64(32)


def false_rate(load: float) -> float:
    """The chance that a cell has the bits of an n-gram that was never inserted, expected at ``load`` probes a cell."""
    filled = [1 - (1 - 1 / 64) ** (BITS * n) for n in range(int(load * 5) + 20)]
    return sum(math.exp(n * math.log(load) - load - math.lgamma(n + 1)) * f**BITS for n, f in enumerate(filled))


def build_filter(grams: np.ndarray, counts: np.ndarray, vocabulary: int, load: float = LOAD, repeats: int | None = None) -> tuple[bytes, int, float]:
    """(cells, cells asked for level 1, chance of a false n-gram) for a segment's counts and a corpus of ``vocabulary`` words."""
    if not len(grams):
        return b"", 1, 0.0
    repeats = repeats or max(2, math.ceil(math.log(max(vocabulary / FALSE_GRAMS, 2)) / -math.log(false_rate(load))))
    level = levels(counts)
    order = np.argsort(-level, kind="stable")
    grams, level = grams[order], level[order]
    probes = len(grams) * repeats + int((level - 1).sum()) * HIGHER
    cells = max(1, math.ceil(probes / load))
    table = np.zeros(cells * 64, np.bool_)
    for q in range(1, int(level[0]) + 1):
        own = grams[: np.searchsorted(-level, -q, "right")]
        for i in range(repeats if q == 1 else HIGHER):
            chosen, key = _probe(own, q, i)
            at = _cell(chosen, np.uint64(cells)) << np.uint64(6)
            for b in range(BITS):
                table[at + ((key >> np.uint64(6 * b)) & np.uint64(63))] = True
    filled = table.reshape(cells, 64).mean(axis=1)
    return np.packbits(table, bitorder="little").tobytes(), repeats, float((filled**BITS).mean() ** repeats)


class Part:
    """Some successive segments of a model: exact counts of words and the filter, for many look-ups at once."""

    def __init__(self, segments: int, rows: list[tuple[int, bytes, bytes, int, bytes]]) -> None:
        """``rows``: (segment, words, word counts, cells asked, filter)"""
        rows = sorted(rows)
        self.segments, self.first = segments, rows[0][0] if rows else 0
        held = rows[-1][0] - self.first + 1 if rows else 0
        self.size, self.repeats = np.zeros(held, np.uint64), np.ones(held, np.int8)
        for s, _, _, r, cells in rows:
            self.size[s - self.first], self.repeats[s - self.first] = len(cells) // 8, r
        self.start = np.cumsum(self.size) - self.size
        each = [[_hashes(r[1]), _values(r[2], np.int64), np.frombuffer(r[4], np.uint64)] for r in rows] or [[np.zeros(0, k) for k in (np.uint64, np.int64, np.uint64)]]
        self.words, self.counts, self.cells = map(np.concatenate, zip(*each, strict=True))

    def count(self, words: np.ndarray) -> np.ndarray:
        """The exact counts of words; those of other parts get 0."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)

    def level(self, grams: np.ndarray) -> np.ndarray:
        """The levels of n-grams; those of other parts get 0."""
        out = np.zeros(len(grams), np.uint16)
        segment = segment_of(grams, self.segments) - self.first
        live = np.flatnonzero((segment >= 0) & (segment < len(self.size)))
        live = live[self.size[segment[live]] > 0]
        x, segment = grams[live], segment[live]
        start, size, repeats = self.start[segment], self.size[segment], self.repeats[segment]
        q = 1
        while len(live):
            keep = np.arange(len(live))
            for i in range(int(repeats.max()) if q == 1 else HIGHER):
                chosen, key = _probe(x[keep], q, i)
                asked = np.uint64(1) << (key & np.uint64(63))
                for b in range(1, BITS):
                    asked |= np.uint64(1) << ((key >> np.uint64(6 * b)) & np.uint64(63))
                hit = (self.cells[start[keep] + _cell(chosen, size[keep])] & asked) == asked
                if q == 1:
                    hit |= i >= repeats[keep]
                keep = keep[hit]
            live, x, start, size, repeats = live[keep], x[keep], start[keep], size[keep], repeats[keep]
            out[live] = q
            q += 1
        return out


def asked(text: Slice, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A slice's different words and n-grams, sorted."""
    return np.sort(text.vocabulary), np.unique(np.concatenate(text.grams(order)))


def answered(text: Slice, order: int, counts: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
    """Each token's exact count and the levels of the n-grams that end there, from the answers to ``asked``."""
    own = np.empty_like(counts)
    own[np.argsort(text.vocabulary, kind="stable")] = counts
    place = np.unique(np.concatenate(text.grams(order)), return_inverse=True)[1]
    return [own[text.ids], *found[place].reshape(order - 1, len(text.ids))]


def probabilities(text: Slice, found: list[np.ndarray], n: int, v: int, chance: float) -> np.ndarray:
    """The model's probability of each token, from what ``answered`` says of it."""
    words = found[0].astype(np.float64)
    out = (words + 1) / (n + v + 1)
    end = words[text.bounds[1] - 1] if len(text.bounds) > 1 else 0.0
    last = text.before(words, end)  # the word before
    false = chance * np.minimum(last, v)
    context, shorter = last, words
    for k, level in enumerate(found[1:], 2):
        count = np.minimum(count_at(level), np.minimum(context, shorter))
        prior = PRIORS.get(k, PRIOR)
        expected = chance * v if k == 2 else false
        out = np.where(context > 0, (count + prior * out) / (context + expected + prior), out)
        context, shorter = text.before(count, end), count
    return out


_SLICES = "slice long, doc_ids binary, none binary, held_out binary, vocabulary binary, ids binary, bounds binary"


def tokenized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", held_out: str = "held_out", slice_bytes: int = SLICE) -> tuple[DataFrame, str]:
    """Slices of all documents in the shared folder, and their path."""
    _common.ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), _common.text_bytes(text).alias("data"))

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for n, batch in enumerate(_common.slices(batches, "data", slice_bytes)):
            own = Slice.of(batch.column("data").to_pylist())
            ids = batch.column("doc_id")
            row = (first + n, _planes(ids.fill_null(0).to_numpy()), _planes(ids.is_null().to_numpy(zero_copy_only=False)), _planes(batch.column("held_out").to_numpy(zero_copy_only=False)))
            yield _batch([(*row, own.vocabulary.tobytes(), _planes(own.ids), _planes(own.bounds))], _SLICES)

    return _common.materialize(source.mapInArrow(run, _SLICES), "slices")


def _slices_of(batch: pa.RecordBatch):
    """(row, slice) of each row of a batch of slices."""
    for r in batch.to_pylist():
        yield r, Slice(np.frombuffer(r["vocabulary"], np.uint64), _values(r["ids"], np.int32), _values(r["bounds"], np.int64))


def train(slices: DataFrame, order: int = ORDER, load: float = LOAD, repeats: int | None = None, segments: int | None = None) -> tuple[DataFrame, int]:
    """The model of the documents that aren't held out, as a table in the shared folder (a row a segment), and its number of segments."""
    if order < 2:
        raise ValueError("an n-gram has two words or more")
    if segments is None:
        tokens_ = (slices.agg(F.sum(F.octet_length("ids").cast("long"))).first()[0] or 0) / 4
        segments = max(16, math.ceil(tokens_ / SEGMENT_TOKENS))
    n_segments = 1 << (segments - 1).bit_length()

    def count(batches):
        words, counts, grams, held = [], [], [], 0
        for batch in batches:
            for row, text in _slices_of(batch):
                learned = np.repeat(~_values(row["held_out"], np.bool_), np.diff(text.bounds))
                times = np.bincount(text.ids[learned], minlength=len(text.vocabulary))
                words.append(text.vocabulary[times > 0])
                counts.append(times[times > 0])
                grams += [x[learned] for x in text.grams(order)]
                held += len(text.ids)
                if held >= FLUSH:
                    yield _flush(words, counts, grams, n_segments)
                    words, counts, grams, held = [], [], [], 0
        if held:
            yield _flush(words, counts, grams, n_segments)

    def merge(table: pa.Table) -> pa.Table:
        def joined(name: str, how, *kind) -> np.ndarray:
            return np.concatenate([how(x, *kind) for x in table.column(name).to_pylist()])

        words, counts = _summed(joined("words", _hashes), joined("word_counts", _values, np.int64))
        once = joined("once", _hashes)
        grams = _summed(np.concatenate([once, joined("grams", _hashes)]), np.concatenate([np.ones(len(once), np.int64), joined("gram_counts", _values, np.int64)]))
        cells, cells_asked, chance = build_filter(*grams, len(words) * n_segments, load, repeats)
        return pa.Table.from_batches([_batch([(table.column("segment")[0].as_py(), int(counts.sum()), len(words), _sorted(words), _planes(counts), cells_asked, chance, cells)], _MODEL)])

    model = slices.select("held_out", "vocabulary", "ids", "bounds").mapInArrow(count, _PART).groupBy("segment").applyInArrow(merge, _MODEL)
    return _common.materialize(model, "ngrams")[0], n_segments


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(column: str = "doc_id", modulus: int = 7) -> Column:
    """Rows whose crc32(id as text) leaves 2."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def _sent(model: DataFrame, segments: int):
    """Some of the model's rows as a broadcast."""
    # The part's size bounds these rows; one at a time keeps the JVM's copy small.
    rows = [(r[0], bytes(r[1]), bytes(r[2]), r[3], bytes(r[4])) for r in model.select("segment", "words", "word_counts", "repeats", "filter").toLocalIterator()]
    return model.sparkSession.sparkContext.broadcast(Part(segments, rows))


def segments_a_part(model: DataFrame, part_bytes: int) -> int:
    """How many segments make a part; hash ranges are of much the same size."""
    largest = model.agg(F.max(2 * F.length("words") + F.length("filter"))).first()[0] or 0
    return max(1, part_bytes // max(1, largest))


_ASKED = "part int, slice long, words binary, grams binary"
_ANSWERS = "slice long, part int, counts binary, levels binary"


def score(slices: DataFrame, model: DataFrame, segments: int, order: int = ORDER, part_bytes: int = PART_BYTES) -> DataFrame:
    """Scores of all documents in ``slices`` by a model that ``train`` made with the same ``order``."""
    spark = slices.sparkSession
    n, v, chance = model.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v")], F.coalesce(F.sum("chance"), F.lit(0.0)) / segments).first()
    unknown = math.log10(n + v + 1)
    step = min(segments, segments_a_part(model, part_bytes))

    def ask(batches):
        for batch in batches:
            for row, text in _slices_of(batch):
                each = asked(text, order)
                cut = [np.append(_starts(x, segments)[:-1:step], len(x)) for x in each]
                for k in range(len(cut[0]) - 1):
                    own = [x[c[k] : c[k + 1]] for x, c in zip(each, cut, strict=True)]
                    if len(own[0]) + len(own[1]):
                        yield _batch([(k, row["slice"], *map(_sorted, own))], _ASKED)

    questions, replies = _common.scratch(spark, "asked"), _common.scratch(spark, "answers")
    slices.select("slice", "vocabulary", "ids", "bounds").mapInArrow(ask, _ASKED).write.partitionBy("part").option("compression", "zstd").parquet(questions)
    kept = spark.read.schema("slice long, words binary, grams binary, part int").parquet(questions)
    for k, first in enumerate(range(0, segments, step)):
        part = _sent(model.where(F.col("segment").between(first, first + step - 1)), segments)
        kept.where(F.col("part") == k).mapInArrow(_answer(part), _ANSWERS).write.mode("append").option("compression", "zstd").parquet(replies)
        part.destroy()
    _common.discard(spark, questions)

    def scored(batches):
        for batch in batches:
            for row, text in _slices_of(batch):
                parts = sorted(row["answers"], key=lambda x: x["part"])
                counts, found = (np.concatenate([_values(x[c], kind) for x in parts]) for c, kind in (("counts", np.int64), ("levels", np.uint16)))
                each = answered(text, order, counts, found)
                starts, total = text.bounds[:-1], np.diff(text.bounds)
                known = np.add.reduceat((each[0] > 0).astype(np.int64), starts)
                base = np.add.reduceat(np.log10(each[0] + 1.0), starts) - total * unknown
                lm = np.add.reduceat(np.log10(probabilities(text, each, n, v, chance)), starts)
                ids = pa.array(_values(row["doc_ids"], np.int64), mask=_values(row["none"], np.bool_))
                columns = [ids, pa.array(_values(row["held_out"], np.bool_)), pa.array(total, pa.int64()), pa.array(known), pa.array(np.full(len(total), n, np.int64)), pa.array(base), pa.array(lm)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    answers = spark.read.schema(_ANSWERS).parquet(replies).groupBy("slice").agg(F.collect_list(F.struct("part", "counts", "levels")).alias("answers"))
    return slices.join(answers, "slice").mapInArrow(scored, _SCORED)


def _answer(part):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, grams = _hashes(r["words"]), _hashes(r["grams"])
                yield _batch([(r["slice"], r["part"], _planes(part.value.count(words)), _planes(part.value.level(grams)))], _ANSWERS)

    return run


def op10_bloom_lm(spark, sf_dir: str) -> DataFrame:
    """Exact add-one word scores and the model's for every document, learned from those not held out."""
    slices, _ = tokenized(_common.read(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text"))
    model, segments = train(slices)
    return score(slices, model, segments)
