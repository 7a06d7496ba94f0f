"""Document quality by the votes of labelled neighbours in a latent-semantic space.

``fit`` takes at most ``sample`` labelled documents (those whose id hashes lowest), counts their
words and word shapes in ``TERMS`` hashed terms, and finds the ``RANK`` leading directions of their
weighted counts by a randomized singular value decomposition. The labelled vectors and the
projection are broadcast: ``sample`` and ``TERMS`` bound them (7 MB), whatever the corpus.
``classify`` projects every document, computes its cosine with every labelled vector in blocks,
exactly, and averages the labels of the ``NEIGHBOURS`` nearest, weighted by similarity. A score
uses the text alone.

Defined results: null texts count as empty; a text without words, or without a similar neighbour,
gets the mean label; without any label scores are 0.5. Labels that are null or whose document is
missing aren't used, and several of one document are averaged; rows are scored each by itself;
similarities that are equal to 20 binary digits go to the neighbour with the lower id hash. Row-local but
for the sample.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from vellumix.llm import _common

TERMS = 4096  # half for words, half for shapes
RANK, NEIGHBOURS, SAMPLE, POWER = 48, 25, 4096, 8
BLOCK = 256
KEEP = 0.7


def shape(word: str) -> str:
    """The kinds of characters in a word, runs of a kind once: "Word," is "Aa,"."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


class TermPairs(dict):
    """Word (bytes) to its word term and its shape's term, in one number; remembers a bounded number."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        text = word.decode(errors="replace")
        half = TERMS // 2
        a = xxhash.xxh3_64_intdigest(text.lower().encode()) % half
        b = half + xxhash.xxh3_64_intdigest(shape(text).encode()) % half
        pair = a * TERMS + b
        if len(self) < self.MOST:
            self[word] = pair
        return pair


def counts(texts: list[bytes], terms: TermPairs) -> np.ndarray:
    """Term counts, a row a text. A word that repeats the one before it counts as a term of its own."""
    each = [t.split() for t in texts]
    sizes = [len(x) for x in each]
    pairs = np.fromiter((p for x in each for p in map(terms.__getitem__, x)), np.int64, sum(sizes))
    row = np.repeat(np.arange(len(texts)), sizes) * TERMS
    again = np.flatnonzero((pairs[1:] == pairs[:-1]) & (row[1:] == row[:-1])) + 1
    at = np.concatenate([row + pairs // TERMS, row + pairs % TERMS, row[again] + TERMS - 1])
    return np.bincount(at, minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` columns with the largest cosines of each row, to 20 binary digits; of equal ones the first."""
    n = cosine.shape[1]
    order = np.rint(cosine * 2.0**20).astype(np.int64) * n - np.arange(n)  # no two are equal
    return np.argpartition(-order, k - 1, axis=1)[:, :k]


class Model:
    """Weights of terms, their projection, the labelled vectors and their labels."""

    def __init__(self, found: np.ndarray, labels: np.ndarray) -> None:
        n = len(found)
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean()) if n else 0.5
        self.weights = np.log((1 + n) / (1 + (found > 0).sum(axis=0))).astype(np.float32) + 1
        x = self.weighed(found)
        rank = min(RANK, n)
        # Randomized range finder with power steps, then the small problem exactly.
        start = np.random.default_rng(7).standard_normal((TERMS, min(rank + 16, max(n, 1)))).astype(np.float32)
        for _ in range(4):
            start = np.linalg.qr(x.T @ (x @ start))[0] if n else start
        left, _, right = np.linalg.svd(x @ start, full_matrices=False) if n else (None, None, start.T[:0])
        self.projection = (start @ right.T[:, :rank]).astype(np.float32) if n else np.zeros((TERMS, 0), np.float32)
        self.vectors = _unit(x @ self.projection)

    def weighed(self, found: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(found) * self.weights)

    def scores(self, found: np.ndarray) -> np.ndarray:
        """The weighted share of good labels among the nearest, for rows of counts."""
        out = np.full(len(found), self.mean)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(found), BLOCK):
            cosine = _unit(self.weighed(found[at : at + BLOCK]) @ self.projection) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            some = np.flatnonzero(total > 1e-9)
            out[at + some] = (weight * self.labels[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0, 1)


def held_out(column: str = "doc_id", modulus: int = 4) -> Column:
    """Rows whose crc32(id as text) leaves 2."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` rows of ``labels`` (id, label)."""
    _common.ship(docs.sparkSession)
    chosen = labels.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    texts = docs.select(F.col(id_column).alias("id"), _common.text_bytes(text).alias("data"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)  # proves the broadcast's bound

    def run(batches):
        terms = TermPairs()
        for batch in _common.slices(batches, "data"):
            for part in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                found = counts(part.column("data").to_pylist(), terms)
                rows = [np.flatnonzero(r) for r in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([r.astype(np.int16).tobytes() for r in rows], pa.binary()), pa.array([x[r].tobytes() for x, r in zip(found, rows, strict=True)], pa.binary())], names=["id", "y", "at", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    got = texts.join(F.broadcast(chosen), "id").select("id", "y", "data").mapInArrow(run, f"id {kind}, y double, at binary, n binary")
    # A document with repeated rows counts once; at most ``sample`` rows of at most TERMS numbers.
    rows = got.groupBy("id").agg(F.max("y").alias("y"), F.max(F.struct("at", "n")).alias("x")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    found = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        found[i, np.frombuffer(r.x.at, np.int16)] = np.frombuffer(r.x.n, np.float32)
    return Model(found, np.array([r.y for r in rows]))


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = KEEP) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), in place of columns of that name."""
    kept = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns if c not in ("score", "predicted")]
    return judged(df, model, text, threshold).select(*kept, "score", "predicted")


def accepted(df: DataFrame, model: Model, text: str = "text", threshold: float = KEEP) -> DataFrame:
    """The rows of ``df`` that are predicted good, as they are, whatever their columns are called."""
    return judged(df, model, text, threshold).where("predicted = 1").select(*_common.with_text(df, text, F.lit(False)))


def judged(df: DataFrame, model: Model, text: str, threshold: float) -> DataFrame:
    """(row, text, score, predicted): the rows' other columns as structs, so that none of them clashes with the verdict's."""
    _common.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(_common.without_text(df, text), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([*source.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        terms = TermPairs()
        for batch in _common.slices(batches, "text"):
            for part in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                score = shared.value.scores(counts(texts, terms))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)


def op9_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labelled rows that aren't held out."""
    docs = _common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _common.read(spark, sf_dir, "labels").where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return classify(rows, model).select("doc_id", "held_out", "score", "predicted")
