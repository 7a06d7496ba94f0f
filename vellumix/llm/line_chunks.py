"""Removal of repeated passages by content-defined chunks of lines, in DataFrame functions only.

A hash rolls over each two neighbouring line hashes; a chunk begins at a line where it is a local
minimum. That depends on a few lines around the place and on nothing before them, so inserted
lines don't move the boundaries of a passage further down. These chunks have two lines at least.
``FAMILIES`` rolling hashes with different keys cut each text in as many ways; one is enough, as
below.

A passage of a few lines has often no such chunk, and its edges lie outside of any. So each two
successive lines with words (and the blank lines between) are a chunk too, and each line of over
``LONG_WORDS`` words: a repeated passage of two lines or more is covered from its first to its last
line, however long, as is a long line alone. A single line of fewer words stays.

A chunk whose hash occurs more than once stays at its first place, by (id, text hash, line), and
its other places lose their lines; before that all places' bytes are compared. Every removed line
stands in an earlier place's chunk, so at least one copy of every line stays.

Shuffles: chunk hashes (no text) to count them; the places of repeated ones back to their
documents, with the texts once; and the texts of repeated chunks, equal ones summed in each task
first, to compare their bytes. A chunk that any share of all documents holds is a large partition
of a plain join, which Spark splits.

Defined results: a null text counts as empty and stays null; equal rows (id and text) count as one
place, so both stay as they are; a null id is less than any other; empty tables stay empty. The
input's columns are carried as one struct, so none of them clashes with the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumix.llm import _common

FAMILIES = 1
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]"
#: More than LONG_WORDS words; possessive, so that it never goes back.
LONG = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % LONG_WORDS


def _rolled(family: int) -> Column:
    """For each line, the family's hash of it and the line before it."""
    return F.transform("_hashes", lambda x, i: F.xxhash64(F.lit(family), F.get("_hashes", i - 1), x))


def _local_minima(rolled: str) -> Column:
    """Places from the third line to the last but one where the column ``rolled`` is a local minimum."""
    n = F.size(rolled)
    inner = F.when(n >= 4, F.sequence(F.lit(2), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: (F.get(rolled, i) < F.get(rolled, i - 1)) & (F.get(rolled, i) <= F.get(rolled, i + 1)))


def chunked(df: DataFrame, text: str = "text", families: int = FAMILIES, modulus: int | None = None) -> DataFrame:
    """``df`` with ``_lines`` and ``_chunks``: (first line, line after the last, hash) of every chunk, pair of lines and long line.

    ``modulus`` makes hashes collide, for tests.
    """
    out = df.withColumn("_lines", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"))
    out = out.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
    out = out.withColumns({f"_rolled{f}": _rolled(f) for f in range(families)})
    out = out.withColumns({f"_cuts{f}": _local_minima(f"_rolled{f}") for f in range(families)})

    def chunk(f: int):
        def made(a: Column, b: Column) -> Column:
            h = F.xxhash64(F.lit(f), F.slice("_hashes", a + 1, b - a))
            return F.struct(a.alias("a"), b.alias("b"), (h if modulus is None else F.pmod(h, F.lit(modulus))).alias("h"))

        return made

    each = [F.zip_with(F.concat(F.array(F.lit(0)), f"_cuts{f}"), F.concat(f"_cuts{f}", F.array(F.size("_lines"))), chunk(f)) for f in range(families)]
    out = out.withColumn("_worded", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get("_lines", i).rlike(WORD)))
    pairs = F.greatest(F.size("_worded") - 1, F.lit(0))
    runs = F.zip_with(F.slice("_worded", F.lit(1), pairs), F.slice("_worded", F.lit(2), pairs), lambda a, z: chunk(families)(a, z + 1))
    long = F.filter("_worded", lambda i: (F.length(F.get("_lines", i)) > 2 * LONG_WORDS) & F.get("_lines", i).rlike(LONG))
    alone = F.transform(long, lambda i: chunk(families + 1)(i, i + 1))
    out = out.withColumn("_chunks", F.concat(F.filter(F.concat(*each), lambda c: c["b"] - c["a"] >= 2), runs, alone))
    return out.drop("_hashes", "_worded", *[f"_{name}{f}" for f in range(families) for name in ("rolled", "cuts")])


def _lists(places: DataFrame) -> DataFrame:
    return places.groupBy("_id", "_text_hash").agg(F.collect_list(F.struct("a", "b", "h", "extra")).alias("_places"))


def _with_lists(df: DataFrame, lists: DataFrame) -> DataFrame:
    lists = lists.select(F.col("_id").alias("_i"), F.col("_text_hash").alias("_t"), "_places")
    return df.join(lists, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_hash") == F.col("_t")), "left").drop("_i", "_t")


def _passage(lines: Column, place: Column) -> Column:
    return F.array_join(F.slice(lines, place["a"] + 1, place["b"] - place["a"]), "\n")


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", families: int = FAMILIES, modulus: int | None = None) -> DataFrame:
    """``df`` with repeated passages taken out of ``text``, and ``n_lines`` and ``n_removed`` in place of columns of that name.

    ``df`` is read twice, so it should be a table.
    """
    out = marked(df, id_column, text, families, modulus)
    rest = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns if c not in ("n_lines", "n_removed")]
    return out.select(*rest, "n_lines", "n_removed")


def deduplicated(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``df`` without repeated passages; documents of which no word is left thereby go. ``n_chars`` follows the text."""
    out = marked(df, id_column, text, FAMILIES, None)
    return _common.only(out, (F.col("n_removed") == 0) | F.col("text").rlike(WORD)).select(*_common.with_text(df, text, F.col("n_removed") > 0))


def marked(df: DataFrame, id_column: str, text: str, families: int, modulus: int | None) -> DataFrame:
    """(row, text, n_lines, n_removed): the rows of ``df`` with their other columns as structs, their texts without repeated passages."""
    own = df.select(_common.without_text(df, text), F.col(f"`{text}`").alias("text"), F.col(f"`{id_column}`").alias("_id"))
    own = own.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    chunks = chunked(own.select("_id", "_text_hash", "text"), "text", families, modulus)
    # Not inline(): the filter that the optimizer makes of it would compute the chunks once more, unshared.
    places = chunks.select("_id", "_text_hash", F.inline_outer("_chunks")).where("h is not null")
    place = F.struct("_id", "_text_hash", "a")
    repeated = places.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    flagged = places.join(_common.apart(repeated), "h").select("_id", "_text_hash", "a", "b", "h", (place != F.col("_first")).alias("extra"))

    found, _ = _common.materialize(_with_lists(own, _lists(flagged)), "line-chunks")
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    passages = found.where("_places is not null").select("_id", "_text_hash", lines.alias("_lines"), F.explode("_places").alias("p")).select("_id", "_text_hash", "p.*", _passage(F.col("_lines"), F.col("p")).alias("_bytes"))
    # Bytes: places of a hash must all hold the same passage.
    different = passages.groupBy("h", "_bytes").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    if not different.groupBy("h").count().where("count > 1").isEmpty():
        # Some hash stands for several passages: let every passage have its own first place.
        exact = passages.drop("extra").join(_common.apart(different), ["h", "_bytes"]).select("_id", "_text_hash", "a", "b", "h", (place != F.col("_first")).alias("extra"))
        found = _with_lists(found.drop("_places"), _lists(exact))
    extra = F.filter("_places", lambda p: p["extra"])
    out = found.withColumn("_lines", lines).withColumn("_gone", F.array_distinct(F.flatten(F.transform(extra, lambda p: F.sequence(p["a"], p["b"] - 1)))))
    out = out.withColumns({"n_lines": F.size("_lines"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))})
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i)), "\n")
    return out.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text"))).select("row", "text", "n_lines", "n_removed")


def op3_line_chunks(spark, sf_dir: str) -> DataFrame:
    """For every document, how many of its lines repeat earlier passages, and what is left without them."""
    docs = _common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
