"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles (all its words if it has fewer). Two texts are
linked if the edit similarity of these sequences, 1 - distance / longer length, is 0.8 or more;
classes are the connected components of the links, with equal texts in one class.

Sketch: each of ``SAMPLES`` keyed hashes of the occurrence-labelled shingles picks the ``PICKS``
smallest and keeps them in text order; texts that agree on one sample are candidates. Linked texts
share two thirds of their shingles at least, so a link is missed by all samples with a chance of
(1 - (2/3)**3)**24, 0.0002, at the threshold, and far less above it. Texts of at most ``SHORT`` shingles
agree on a sample less often (with 0.2 for 4 of 5 shingles) and have ``SHORT_SAMPLES``.

Candidates: the texts of a bucket are first aligned with one of them, the one that lies in the most
populous buckets (of a family of near copies, the likely original). Texts of buckets that this
leaves in several classes are then joined exactly: a link needs so many common shingles that

* a text too few of whose shingles occur in other classes can have no further link, and leaves;
* of what is left, with shingles in order of frequency, rarest first, two linked texts share one of
  their first n - needed + 1; only pairs of different classes that do, and whose lengths allow a
  link, are aligned, and of each such shingle not those within its most frequent class.

No bucket is capped, and no pairs are made within a class.

Scale: equal texts count once from the start. What is shuffled by bucket are 24 small rows for a
text; texts are shuffled only where they are in candidate pairs. Hot buckets and leaders are large
partitions of plain joins, which Spark splits. Components are found by contracting the graph, with
tables in the shared folder; nothing but counts goes to the driver.

Defined results: a null text counts as empty; texts without words link with equal ones only; a
null id is a row like any other, but a class is named by its least id that isn't null; rows with
one id and different texts are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumix.llm import _common

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, PICKS = 24, 3
#: Texts of few shingles agree on a sample less often than in the limit, and get more samples.
SHORT, SHORT_SAMPLES = 16, 72
ROUNDS = 3  # of dropping texts without possible links; any number from 1 is right
_MOST = np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int) -> np.uint64:
    return np.uint64((n + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1) | 1)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, one text after another, and how many each text has."""
    each = [t.split() for t in texts]
    size = np.array([len(x) for x in each], np.int64)
    index = _Index()
    ids = np.fromiter((i for x in each for i in map(index.__getitem__, x)), np.int64, int(size.sum()))
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))[ids]
    n = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    first = np.repeat(np.cumsum(size) - size, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    length = np.repeat(np.minimum(size, SHINGLE), n)
    out = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        step = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + k, max(len(words) - 1, 0))]) if len(words) else out
        out = np.where(length > k, step, out)
    return out, n


def labelled(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hashes with the number of their occurrence in their text mixed in."""
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = _mix(hashes ^ _mix(text + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    same = np.append(False, sorted_[1:] == sorted_[:-1])
    if not same.any():
        return _mix(hashes)
    at = np.arange(len(key))
    start = np.maximum.accumulate(np.where(same, 0, at))
    occurrence = np.zeros(len(key), np.uint64)
    occurrence[order] = (at - start).astype(np.uint64)
    return _mix(hashes + occurrence * np.uint64(0xD6E8FEB86659FD93))


#: About so many of a text's labels are looked at for a sample's smallest ones.
NARROW = 14


def sketches(labels: np.ndarray, n: np.ndarray, samples: int = SAMPLES, picks: int = PICKS, first: int = 0) -> np.ndarray:
    """For each text with shingles, a key for each sample from the ``first`` on: its smallest labels in text order."""
    n = n[n > 0]
    out = np.zeros((len(n), samples), np.uint64)
    if not len(n):
        return out
    text_of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    # The smallest ones are nearly always under a bound that depends on the length alone.
    bound = np.where(n > NARROW, (NARROW / n * 2.0**64).clip(max=2.0**63 * 1.99), 0).astype(np.uint64)
    bound[n <= NARROW] = _MOST
    under, want, last = np.repeat(bound, n), np.minimum(n, picks), len(labels)
    for s in range(samples):
        v = labels * _odd(first + s)
        at = np.flatnonzero(v <= under)
        text = text_of[at]
        short = np.flatnonzero(np.bincount(text, minlength=len(n)) < want)
        if len(short):  # too few under the bound: look at all of these texts' labels
            at = np.sort(np.concatenate([at[~np.isin(text, short)], np.flatnonzero(np.isin(text_of, short))]))
            text = text_of[at]
        order = np.lexsort((v[at], text))
        at, text = at[order], text[order]
        begin = np.searchsorted(text, np.arange(len(n)))
        rank = np.arange(len(at)) - begin[text]
        places = np.full((len(n), picks), last)
        chosen = rank < picks
        places[text[chosen], rank[chosen]] = at[chosen]
        places.sort(axis=1)
        key = np.full(len(n), _odd(first + s + 1000))
        for p in range(picks):
            here = places[:, p]
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(here < last, labels[np.minimum(here, last - 1)], np.uint64(0)))
        out[:, s] = key
    return out


def _band(a: list[int], b: list[int], t: int) -> int:
    """The edit distance if it is at most ``t``, else more than ``t``; ``a`` is the longer and has ``t`` items or more.

    Myers' bit vectors over the 2t + 1 diagonals around the main one, which move down a row with
    every column.
    """
    width = 2 * t + 1
    mask = (1 << width) - 1
    match: dict[int, int] = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    vp, vn, distance = mask >> t << t, 0, t
    top, edge = 1 << (width - 1), 1 << (width - 2)
    give_up = 2 * t + len(b) - len(a)
    for j, x in enumerate(b):
        bits = match.get(x, 0)
        bits = (bits << t - j if j < t else bits >> j - t) & mask
        d0 = ((((bits & vp) + vp) ^ vp) | bits | vn) & mask
        hp, hn = vn | (mask & ~(d0 | vp)), d0 & vp
        if j < len(a) - t:
            distance += not d0 & top
            if distance > give_up:
                return t + 1
        else:
            distance += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        d0 >>= 1
        vp, vn = hn | (mask & ~(d0 | hp)), d0 & hp
    return distance


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences by banded alignment, or None if it is more than ``most``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    different = np.flatnonzero(a[: len(b)] != b)
    start = int(different[0]) if len(different) else len(b)
    a, b = a[start:], b[start:]
    if len(b):
        different = np.flatnonzero(a[len(a) - len(b) :][::-1] != b[::-1])
        end = int(different[0]) if len(different) else len(b)
        a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(b):
        return len(a) if len(a) <= most else None
    if not most:
        return None
    x, y = a.tolist(), b.tolist()
    t = max(8, len(x) - len(y))
    while True:
        t = min(t, most, len(x))
        got = _band(x, y, t)
        if got <= t:
            return got
        if t >= most or t >= len(x):
            return None
        t *= 4


def allowed(longer: int) -> int:
    """The largest distance of a link between texts of which the longer has so many shingles."""
    return int((1 - SIMILARITY) * longer + 1e-9)


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts, as (hashes, sorted labels), are similar enough."""
    longer = max(len(a[0]), len(b[0]))
    most = allowed(longer)
    if longer == 0 or abs(len(a[0]) - len(b[0])) > most:
        return False
    # No alignment can match more shingles than the texts share.
    if longer - len(np.intersect1d(a[1], b[1], assume_unique=True)) > most:
        return False
    return distance(a[0], b[0], most) is not None


def parsed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes, n = shingles([text])
    return hashes, np.sort(labelled(hashes, n))


def digest(text: str = "text") -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(_common.text_bytes(text), 256)), 1, 16)


def sketch(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n, keys): each row's text digest, number of shingles and sample keys."""
    _common.ship(docs.sparkSession)

    def run(batches):
        for batch in _common.slices(batches, "data", 3 << 20):
            hashes, n = shingles(batch.column("data").to_pylist())
            labels, short = labelled(hashes, n), (n > 0) & (n <= SHORT)
            more = sketches(labels[np.repeat(short, n)], n[short], SHORT_SAMPLES - SAMPLES, first=SAMPLES)
            size = np.where(n > 0, SAMPLES, 0) + np.where(short, SHORT_SAMPLES - SAMPLES, 0)
            offsets = np.concatenate([[0], np.cumsum(size)])
            keys = np.zeros(int(offsets[-1]), np.uint64)
            keys[offsets[:-1][n > 0][:, None] + np.arange(SAMPLES)] = sketches(labels, n)
            keys[offsets[:-1][short][:, None] + np.arange(SAMPLES, SHORT_SAMPLES)] = more
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n.astype(np.int32)), lists], names=["doc_id", "digest", "n", "keys"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), digest(text).alias("digest"), _common.text_bytes(text).alias("data"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n int, keys array<long>")


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(v, c) for every vertex of ``edges`` (a, b): c is one vertex of v's component, the same for all of it.

    Each round, every vertex joins its neighbour (or itself) of the lowest hash, and the graph is
    contracted. Also returns the paths of the tables that the result needs.
    """
    edges, path = _common.materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, kept = None, []
    for turn in range(1000):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        best = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("best")).select("v", F.least("best", rank("v"))["v"].alias("p"))
        parents, parents_path = _common.materialize(best, "parents")
        if labels is None:
            labels, kept = parents.withColumnRenamed("p", "c"), [parents_path]
        else:
            # A vertex that is contracted into one without edges left keeps that name.
            labels = labels.join(parents.withColumnRenamed("v", "c"), "c", "left").select("v", F.coalesce("p", "c").alias("c"))
            kept.append(parents_path)
        mapped = edges.join(parents.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parents.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges, next_path = _common.materialize(mapped.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        _common.discard(edges.sparkSession, path)
        path = next_path
        if edges.isEmpty():
            _common.discard(edges.sparkSession, path)
            return labels, kept
    raise RuntimeError("the graph did not contract")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: digests) whose texts are linked."""

    def run(batches):
        name, leader = None, None
        for batch in _common.slices(batches, "y", 4 << 20):
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if a != name:
                    name, leader = a, parsed(x)
                keep.append(linked(leader, parsed(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    members = pairs.join(texts.select(F.col("digest").alias("b"), F.col("data").alias("y")), "b")
    whole = members.join(texts.select(F.col("digest").alias("a"), F.col("data").alias("x")), "a")
    return whole.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _in_reach(a: str, b: str) -> Column:
    longer = F.greatest(a, b)
    return F.abs(F.col(a) - F.col(b)) <= F.floor(F.lit(1 - SIMILARITY) * longer + F.lit(1e-9))


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, class_id, class_digest, n_links, n_copies) for every row of ``docs``.

    ``class_id`` and ``class_digest`` name the document of the class with the least id (of several
    texts with that id, the least digest); ``n_links`` counts the links of the row's text with other
    texts that were tried and verified, which may not be all it has; ``n_copies`` the rows with an equal
    text. ``docs`` is read more than once, so it should be a table.
    """
    spark = docs.sparkSession
    sketched, _ = _common.materialize(sketch(docs, id_column, text), "sketches")
    distinct = sketched.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    distinct, _ = _common.materialize(distinct, "texts")

    rows = distinct.select(F.explode("keys").alias("key"), F.col("digest").alias("v"), "n")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members, members_path = _common.materialize(rows.join(_common.apart(sizes), "key"), "buckets")
    popularity = members.groupBy("v").agg(F.sum("size").alias("pop"))
    buckets, buckets_path = _common.materialize(members.drop("size").join(popularity, "v"), "buckets")
    _common.discard(spark, members_path)
    leaders = buckets.groupBy("key").agg(F.max(F.struct("pop", "v", "n")).alias("top")).select("key", F.col("top.v").alias("a"), F.col("top.n").alias("m"))
    pairs = buckets.join(_common.apart(leaders), "key").where((F.col("a") != F.col("v")) & _in_reach("m", "n")).select("a", F.col("v").alias("b")).distinct()
    pairs, pairs_path = _common.materialize(pairs, "pairs")

    texts = _texts(docs, id_column, text, distinct.join(buckets.select(F.col("v").alias("digest")).distinct(), "digest").select("digest", "least"))
    texts, texts_path = _common.materialize(texts, "candidates")
    links, links_path = _common.materialize(verified(pairs, texts), "links")
    labels, kept = components(links)
    more, more_paths = _across(buckets, labels, texts, pairs)
    new, new_path = _common.materialize(verified(more, texts), "links")
    links = links.unionByName(new)
    for path in (buckets_path, texts_path, pairs_path, *kept, *more_paths):
        _common.discard(spark, path)

    labels, _ = components(links)
    ends = links.select(F.col("a").alias("digest")).unionByName(links.select(F.col("b").alias("digest")))
    named = (
        distinct.select("digest", "least", "n_copies")
        .join(labels.select(F.col("v").alias("digest"), "c"), "digest", "left")
        .join(ends.groupBy("digest").agg(F.count(F.lit(1)).alias("n_links")), "digest", "left")
        .withColumn("c", F.coalesce("c", "digest"))
    )
    # A null id sorts after all others here.
    first = named.groupBy("c").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("first"))
    result = named.join(_common.apart(first), "c").select("digest", F.col("first.least").alias("class_id"), F.col("first.digest").alias("class_digest"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return sketched.select("doc_id", "digest").join(_common.apart(result), "digest").select("doc_id", "digest", "class_id", "class_digest", "n_links", "n_copies")


def _across(buckets: DataFrame, labels: DataFrame, texts: DataFrame, tried: DataFrame) -> tuple[DataFrame, list[str]]:
    """All pairs (a, b) of texts in buckets of several classes that may be linked across classes, but those tried.

    Also returns the paths of the tables that the pairs need.
    """
    found = buckets.join(labels, "v", "left").withColumn("c", F.xxhash64(F.coalesce("c", "v")))
    mixed = found.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    open_ = found.join(_common.apart(mixed), "key", "left_semi").select("v", "c", "n").distinct().withColumn("t", F.monotonically_increasing_id())
    open_, open_path = _common.materialize(open_, "open")

    def spread(batches):
        for batch in _common.slices(batches, "data", 1 << 20):
            hashes, n = shingles(batch.column("data").to_pylist())
            columns = {c: np.repeat(batch.column(c).to_numpy(), n) for c in ("t", "c", "n")}
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns.values()), pa.array(labelled(hashes, n).view(np.int64))], names=["t", "c", "n", "h"])

    rows = open_.join(texts.select(F.col("digest").alias("v"), "data"), "v").select("t", "c", "n", "data").mapInArrow(spread, "t long, c long, n int, h long")
    rows, path = _common.materialize(rows, "shingles")
    needed = F.col("n") - F.floor(F.lit(1 - SIMILARITY) * F.col("n") + F.lit(1e-9))
    for _ in range(ROUNDS):
        shared = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("df")).where("low <> high").select("h", "df")
        own = rows.select("t", "c", "n", "h").join(_common.apart(shared), "h").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("t")))
        rows, next_path = _common.materialize(own.where(F.col("shared") >= needed), "shingles")
        _common.discard(rows.sparkSession, path)
        path = next_path
    # In the order of frequency, shingles of one class only come first; no pair of classes has them.
    rarest = Window.partitionBy("t").orderBy("df", "h")
    prefix = rows.withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("shared") - needed + 1)
    prefix, prefix_path = _common.materialize(prefix.select("t", "c", "n", "h"), "prefixes")
    main = prefix.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("classes"))
    main = main.where("classes > 1").select("h", F.col("top.c").alias("main"))
    main, main_path = _common.materialize(main, "main")
    marked = prefix.join(main, "h")
    minor = marked.where(F.col("c") != F.col("main")).select("h", F.col("t").alias("ta"), F.col("c").alias("ca"), F.col("n").alias("m"))
    other = marked.select("h", F.col("t").alias("tb"), F.col("c").alias("cb"), "n", (F.col("c") == F.col("main")).alias("is_main"))
    near = minor.join(other, "h").where((F.col("ca") != F.col("cb")) & (F.col("is_main") | (F.col("ta") < F.col("tb"))) & _in_reach("m", "n"))
    # A pair may be minor on either side for different shingles.
    numbers = near.select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).distinct()
    names = open_.select("t", "v")
    pairs = numbers.join(names.select(F.col("t").alias("ta"), F.col("v").alias("a")), "ta").join(names.select(F.col("t").alias("tb"), F.col("v").alias("b")), "tb").select("a", "b")
    both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti"), [open_path, path, prefix_path, main_path]


def _texts(docs: DataFrame, id_column: str, text: str, wanted: DataFrame) -> DataFrame:
    """One text for each wanted (digest, least id)."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), digest(text).alias("digest"), _common.text_bytes(text).alias("data"))
    wanted = wanted.select(F.col("digest").alias("d"), "least")
    same = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("least"))
    return own.join(wanted, same, "left_semi").dropDuplicates(["digest", "doc_id"]).select("digest", "data")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their classes: of each class, the document with the least id."""
    chosen = classes(docs, id_column, text).select(F.col("class_id").alias("id"), F.col("class_digest").alias("digest")).distinct()
    # The rows as structs, so that none of their columns clashes with these.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(text).alias("own"), F.col(f"`{id_column}`").cast("long").alias("own_id"))
    same = (F.col("own") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("id"))
    return own.join(chosen, same, "left_semi").dropDuplicates(["own", "own_id"]).select("row.*")


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    docs = _common.read(spark, sf_dir, "documents")
    return classes(docs).select("doc_id", "class_id", "n_links", "n_copies")
