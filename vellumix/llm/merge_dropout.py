"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding merges, again and again, the adjacent pair whose merged piece has the best score (the
leftmost of equals). With dropout, a candidate merge, known by the word's occurrence (the text's hash
under the seed, and the word's place in the text) and by where the merge starts, meets and ends in
the word, is skipped if a keyed hash of these is under ``dropout``. So every occurrence of a word draws
its own merges, the same seed always gives the same segmentation, other seeds give others, and all
decode to the same text.

Words are cut before line feeds and before spaces that follow another character, where no piece
reaches across. A slice's different words are segmented once without dropout, noting the merges
made; an occurrence none of whose noted merges is skipped has that segmentation, since skipping
other candidates changes nothing. The rest are segmented by themselves. Words of a length are
segmented together in numpy; ``agenda`` does the same with a priority queue for one word, for very
long words and for the tests. Characters without a piece, and a literal U+2581, are written as
bytes, so every text decodes exactly.

Defined results: a null text is an empty one and has no tokens; repeated rows are encoded each by
itself and alike, as are equal texts; a dropout of 1 leaves single characters. Row-local: no shuffle;
memory is bounded by a slice's words.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumix.llm import _common

SPACE = "▁"
DROPOUT, SEED = 0.1, 20240601
SLICE = 4 << 20  # bytes of texts encoded at a time
LONGEST = 32  # characters of words that are segmented together
#: A space stands for a literal U+2581 here, which real spaces no longer are.
_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n ]*|\n?[^{SPACE}\n ]+|[\n ]")
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_64 = (1 << 64) - 1


def model_path() -> str:
    """The default model's file; ``Merger`` takes any other BPE model with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mix(x: int) -> int:
    x = (x ^ (x >> 30)) * _M1 & _64
    x = (x ^ (x >> 27)) * _M2 & _64
    return x ^ (x >> 31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def place(start: int, meet: int, end: int) -> int:
    return (start << 42 | meet << 21 | end) & _64


def keys_of(text: bytes, n: int, seed: int) -> np.ndarray:
    """The keys of a text's ``n`` words, by their places, that their candidate merges' hashes start from."""
    own = np.uint64(xxhash.xxh3_64_intdigest(text, seed & _64))
    return _mix(own + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def code_points(words: list[str], size: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size)


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Merger:
    """A model's pieces, with a table of which two pieces merge into which."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        if len(self.bytes) != 256 or SPACE not in self.pieces:
            raise ValueError("the model needs byte pieces and one for the space")
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(n, 1 << 30, np.int64)
        self.rank[order] = np.arange(len(order))
        self.low = np.array([self.bytes[b] for b in range(128)], np.int32)
        self.text = [b""] * n
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        for p, i in self.pieces.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        self.n = n
        self.merges = {(a, b): i for p, i in self.pieces.items() for k in range(1, len(p)) if (a := self.pieces.get(p[:k])) is not None and (b := self.pieces.get(p[k:])) is not None}
        self.character = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        # The same as an open-addressed table for numpy.
        self.mask = (1 << (len(self.merges) * 3).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.zeros(self.mask + 1, np.int32)
        self.probes = 1
        for (a, b), i in self.merges.items():
            key = a * n + b
            at = mix(key) & self.mask
            steps = 1
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
                steps += 1
            self.keys[at], self.values[at] = key, i
            self.probes = max(self.probes, steps)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair merges into, or -1."""
        key = a.astype(np.int64) * self.n + b
        at = (_mix(key.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)
        out = np.full(key.shape, -1, np.int32)
        rest = np.arange(key.size)
        key, at, flat = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            seen = self.keys[at]
            hit = seen == key
            flat[rest[hit]] = self.values[at[hit]]
            more = ~hit & (seen >= 0)
            rest, key, at = rest[more], key[more], (at[more] + 1) & self.mask
            if not len(rest):
                break
        return flat.reshape(out.shape)

    def characters(self, word: str) -> list[int]:
        """Each character's piece; those without one get -1 - code point."""
        return [self.pieces.get(c, -1 - ord(c)) for c in word]

    def spelled(self, ids: list[int]) -> list[int]:
        out = []
        for i in ids:
            out += [i] if i >= 0 else [self.bytes[b] for b in (SPACE if i == -1 - ord(" ") else chr(-1 - i)).encode()]
        return out

    def agenda(self, word: str, key: int, dropout: float, made: list[int] | None = None) -> list[int]:
        """One word's pieces, by a priority queue of candidate merges; the places of those made are added to ``made``."""
        ids = self.characters(word)
        end, before, after = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        alive, queue = [True] * len(ids), []
        limit = int(dropout * 2**64)

        def propose(i: int, j: int) -> None:
            piece = self.merges.get((ids[i], ids[j]))
            if piece is not None and mix(key ^ mix(place(i, j, end[j]))) >= limit:
                heapq.heappush(queue, (int(self.rank[piece]), i, j, end[j], end[i], piece))

        for i in range(len(ids) - 1):
            propose(i, i + 1)
        while queue:
            _, i, j, stop, meet, piece = heapq.heappop(queue)
            if not (alive[i] and j < len(ids) and alive[j]) or after[i] != j or end[j] != stop or end[i] != meet:
                continue
            if made is not None:
                made.append(place(i, j, stop))
            ids[i], end[i], alive[j], after[i] = piece, stop, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                propose(i, after[i])
            if before[i] >= 0:
                propose(before[i], i)
        return self.spelled([x for x, a in zip(ids, alive, strict=True) if a])

    def together(self, points: np.ndarray, keys: np.ndarray, dropout: float, made: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The merged pieces of many words of one length, as (rows of ``points``, their pieces); (rows, places) of the merges are added to ``made``."""
        ids, width = self.character[points], points.shape[1]
        out, live = [], np.arange(len(ids))
        limit = np.uint64(min(int(dropout * 2**64), _64))
        bounds = np.tile(np.arange(width + 1, dtype=np.uint64), (len(ids), 1))  # where each piece starts, and the end
        while len(live):
            if ids.shape[1] == 1:
                return [*out, (live, ids)]
            piece = self.merged(ids[:, :-1], ids[:, 1:])
            piece[(ids[:, :-1] < 0) | (ids[:, 1:] < 0)] = -1
            if dropout > 0:
                spot = bounds[:, :-2] << np.uint64(42) | bounds[:, 1:-1] << np.uint64(21) | bounds[:, 2:]
                piece[_mix(keys[:, None] ^ _mix(spot)) < limit] = -1
            rank = np.where(piece >= 0, self.rank[piece], 1 << 40)
            best = rank.argmin(axis=1)
            found = rank[np.arange(len(live)), best] < 1 << 40
            out.append((live[~found], ids[~found]))
            live, ids, keys, bounds, piece, best = live[found], ids[found], keys[found], bounds[found], piece[found], best[found]
            row = np.arange(len(live))
            if made is not None and len(live):
                made.append((live, bounds[row, best] << np.uint64(42) | bounds[row, best + 1] << np.uint64(21) | bounds[row, best + 2]))
            ids[row, best] = piece[row, best]
            # The second piece of the pair leaves, and with it the bound where they met.
            at = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, at + (at > best[:, None]), axis=1)
            at = np.arange(bounds.shape[1] - 1)
            bounds = np.take_along_axis(bounds, at + (at > best[:, None]), axis=1)
        return out

    def words(self, text: str) -> list[str]:
        """A text's words, spaces written as U+2581 and a literal one as a space; a space goes before all."""
        if not text:
            return []
        return _WORDS.findall(SPACE + text.translate({0x20: SPACE, 0x2581: " "}))

    def word_refs(self, text: str, index: _Index) -> np.ndarray:
        """``words`` as places in ``index``, which has them marked: after a U+2581 as they are, else without the space before them."""
        if SPACE not in text:
            found = text.replace("\n", " \n").split(" ")
            if "" not in found:  # no two spaces together, so all words but those after line feeds have one before them
                return np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        return np.array([index[w if w[0] == "\n" else w[1:] if len(w) > 1 and w[0] == SPACE != w[1] else SPACE + w] for w in self.words(text)], np.int64)

    @staticmethod
    def marked(word: str) -> str:
        """The word that ``word_refs`` marked."""
        return word if word[0] == "\n" else word[1:] if word[0] == SPACE else SPACE + word

    def segment(self, words: list[str], refs: np.ndarray, keys: np.ndarray, dropout: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of ``words[r]`` for each of ``refs`` with its key, one after another, and where each one's begin (and the end).

        (numbers of refs, places) of the merges are added to ``made``.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        blocks, sizes = [], np.zeros(len(refs), np.int64)
        of_ref = size[refs]
        order = np.argsort(of_ref, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(of_ref[order])) + 1):
            if not len(own):
                continue
            width = int(of_ref[own[0]])
            if width > LONGEST:
                parts = []
                for i in own.tolist():
                    done: list[int] = []
                    parts.append((np.array([i]), np.array([self.agenda(words[refs[i]], int(keys[i]), dropout, done)], np.int32)))
                    if made is not None:
                        made.append((np.full(len(done), i), np.array(done, np.uint64)))
            else:
                different, at = np.unique(refs[own], return_inverse=True)
                points = code_points([words[r] for r in different.tolist()], width)[at]
                noted: list | None = None if made is None else []
                parts = [(own[rows], ids) for rows, ids in self.together(points, keys[own], dropout, noted)]
                if made is not None:
                    made += [(own[rows], places) for rows, places in noted]
            for rows, ids in parts:
                low = (ids < 0) & (ids >= -128) & (ids != -1 - ord(" "))
                ids[low] = self.low[-1 - ids[low]]
                odd = (ids < 0).any(axis=1)  # these have other characters to be spelled
                for i, x in zip(rows[odd], ids[odd], strict=True):
                    blocks.append((np.array([i]), np.array([self.spelled(x.tolist())], np.int32)))
                blocks.append((rows[~odd], ids[~odd]))
        for rows, ids in blocks:
            sizes[rows] = ids.shape[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(int(starts[-1]), np.int32)
        for rows, ids in blocks:
            flat[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, starts

    def occurrences(self, words: list[str], refs: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``segment`` for many occurrences of few words, and how many pieces each has without dropout."""
        made: list = []
        flat, starts = self.segment(words, np.arange(len(words)), np.zeros(len(words), np.uint64), 0.0, made)
        plain = np.diff(starts)
        first, size = starts[:-1][refs], plain[refs]
        if dropout > 0 and made:
            at = np.concatenate([rows for rows, _ in made])
            order = np.argsort(at, kind="stable")
            hashes = _mix(np.concatenate([places for _, places in made]))[order]
            n = np.bincount(at, minlength=len(words))
            begin = np.cumsum(n) - n
            limit = np.uint64(min(int(dropout * 2**64), _64))
            times = n[refs]
            which = np.repeat(np.arange(len(refs)), times)
            number = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            skipped = _mix(keys[which] ^ hashes[begin[refs][which] + number]) < limit
            redo = np.flatnonzero(np.bincount(which[skipped], minlength=len(refs)))
            other, at = self.segment(words, refs[redo], keys[redo], dropout)
            first[redo], size[redo] = len(flat) + at[:-1], np.diff(at)
            flat = np.concatenate([flat, other])
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])]
        return ids, bounds, plain[refs]

    def encode(self, text: str, dropout: float = 0.0, seed: int = SEED) -> list[int]:
        """One text's ids."""
        words = self.words(text)
        return self.segment(words, np.arange(len(words)), keys_of(text.encode(), len(words), seed), dropout)[0].tolist()

    def decode(self, ids) -> str:
        """The text that ``encode`` got: pieces and bytes joined, without the space put before them."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode(errors="replace")


_ENCODED = "doc_id long, n_tokens long, n_plain long, ids_crc32 long, lossless boolean, ids binary"


def kept_merger(path: str) -> Merger:
    """The merger of a model's file, built once in a worker."""
    if ("merger", path) not in _common.KEPT:
        _common.KEPT.clear()  # what another operator has kept
        _common.KEPT["merger", path] = Merger(path)
    return _common.KEPT["merger", path]


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, dropout: float = DROPOUT, seed: int = SEED, keep_ids: bool = True) -> DataFrame:
    """Each text's ids (little-endian 32-bit bytes), how many there are, how many without dropout, and whether they decode to the text."""
    if not 0 <= dropout <= 1:
        raise ValueError("dropout is from 0 to 1")
    _common.ship(docs.sparkSession)
    path = path or model_path()

    def run(batches):
        merger = kept_merger(path)
        for batch in _common.slices(batches, "data", SLICE, keep=True):
            texts = batch.column("data").to_pylist()
            index = _Index()
            each = [merger.word_refs(t.decode(errors="replace"), index) if t else np.zeros(0, np.int64) for t in texts]
            keys = [keys_of(t, len(r), seed) for t, r in zip(texts, each, strict=True)]
            ids, bounds, plain = merger.occurrences(list(map(merger.marked, index)), np.concatenate(each), np.concatenate(keys), dropout)
            cut = np.cumsum([0, *map(len, each)])
            total, pieces, data, rows = np.concatenate([[0], np.cumsum(plain)]), merger.text.__getitem__, ids.astype("<i4"), []
            for (a, b), t in zip(pairwise(cut), texts, strict=True):
                own = data[bounds[a] : bounds[b]]
                rows.append((len(own), int(total[b] - total[a]), zlib.crc32(own), b"".join(map(pieces, own.tolist()))[1:] == t, own.tobytes() if keep_ids else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in _ENCODED.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), _common.text_bytes(text).alias("data")).mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from ids; null ids give null."""
    _common.ship(encoded.sparkSession)
    path = path or model_path()

    def run(batches):
        merger = kept_merger(path)
        for batch in batches:
            texts = [None if x is None else merger.decode(np.frombuffer(x, "<i4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_column).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {encoded.schema[id_column].dataType.simpleString()}, text string").withColumnRenamed("doc_id", id_column)


def op7_merge_dropout(spark, sf_dir: str) -> DataFrame:
    """All documents encoded with dropout: token counts, the ids' checksum and whether they decode to the text."""
    return encode(_common.read(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
