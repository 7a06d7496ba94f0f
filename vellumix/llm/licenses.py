"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line of a text or a run of lines; blocks and templates are sets of words. A template is found in a
block if the block holds at least ``threshold`` of its words (containment). A notice wrapped over
lines is found in windows of as many words as the template has, over line feeds, if no line there
holds it by itself; windows that overlap are one block. Words are ordered by
how many blocks of the whole corpus hold them, rarest first. Then

* prefix filter: a block that reaches the overlap a template needs holds one of the template's
  first |T| - needed + 1 words;
* length filter: it has at least ``needed`` words of any template;
* positional filter: from the first word the two share, what is left of both must suffice.

All three only drop pairs that can't reach the threshold, so the join is exact.

Only the templates' words need counts, so what goes to the driver and back is bounded by the
templates (a few hundred words), whatever the corpus. Both passes over the texts are row-local:
counts are summed in each partition before the one small shuffle.

Defined results: a null text is empty; blank lines are no blocks; repeated rows are scanned each
by itself; ties between templates are all reported; templates with fewer than ``MIN_WORDS`` words
are refused, as they would match by accident.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumix.llm import _common

# Notices as licenses ask for them to be written, and short licenses in full, by label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ),
)
# Phrases whose words stand consecutively, with their labels.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

THRESHOLD, MIN_WORDS = 0.8, 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z lower-cased, and a space for every byte outside words ([0-9a-z] and all beyond ASCII).
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def phrase_places(found: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    out = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        # By its last word but for the common one: look where the rarest part may stand.
        key = len(parts) - 1
        at = -1
        try:
            while True:
                at = found.index(parts[key], at + 1)
                if at >= key and found[at - key : at + 1] == parts:
                    out.append((at - key, label))
        except ValueError:
            pass
    return sorted(out)


class Index:
    """The templates' words in the corpus's order, and for each prefix word its templates."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        sets = [(label, set(words(text.encode()))) for label, text in templates]
        if any(len(s) < MIN_WORDS for _, s in sets):
            raise ValueError(f"a template needs {MIN_WORDS} different words at least")
        universe = sorted(set().union(*(s for _, s in sets)), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(universe)}
        self.labels = [label for label, _ in sets]
        self.sizes = [len(s) for _, s in sets]
        self.lengths = [len(words(text.encode())) for _, text in templates]
        self.needed = [math.ceil(threshold * n - 1e-9) for n in self.sizes]
        self.sorted = [sorted(self.rank[w] for w in s) for _, s in sets]
        self.places: dict[int, list[tuple[int, int]]] = {}  # rank -> (template, position in it)
        for t, (own, need) in enumerate(zip(self.sorted, self.needed, strict=True)):
            for position, r in enumerate(own[: len(own) - need + 1]):
                self.places.setdefault(r, []).append((t, position))
        self.prefix_words = {w for w, r in self.rank.items() if r in self.places}
        self.least = min(self.needed, default=0)
        self.sets = [frozenset(own) for own in self.sorted]
        self.explained = explained(self.sets, self.needed)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that the block holds."""
        if len(block) < self.least or self.prefix_words.isdisjoint(block):
            return []
        own = sorted(self.rank[w] for w in block if w in self.rank)
        if len(own) < self.least:
            return []
        seen, out, every = set(), [], frozenset(own)
        for i, r in enumerate(own):
            for t, position in self.places.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # this is the first word that the two share
                if 1 + min(self.sizes[t] - position - 1, len(own) - i - 1) < self.needed[t]:
                    continue
                overlap = len(every & self.sets[t])
                if overlap >= self.needed[t]:
                    out.append((t, overlap / self.sizes[t]))
        return sorted(out)


    def wrapped(self, lines: list[list[bytes]], own: dict[int, list[tuple[int, float]]]) -> list[tuple[int, int, list[tuple[int, float]]]]:
        """(first line, last line, matches) of each run of lines that hold templates together; ``own`` has the lines' matches."""
        hits, at = [], 0
        for n, line in enumerate(lines):
            hits += [(at + i, n, self.rank[w]) for i, w in enumerate(line) if w in self.rank]
            at += len(line)
        present = {r for _, _, r in hits}
        alone = {n: {t for t, _ in found} for n, found in own.items()}
        spans = []
        for t in sorted({t for r in present for t, _ in self.places.get(r, ())}):
            if len(present & self.sets[t]) < self.needed[t]:
                continue
            mine, held, low = [h for h in hits if h[2] in self.sets[t]], Counter(), 0
            for place, n, r in mine:
                held[r] += 1
                while place - mine[low][0] >= self.lengths[t]:
                    held[mine[low][2]] -= 1
                    if not held[mine[low][2]]:
                        del held[mine[low][2]]
                    low += 1
                first = mine[low][1]
                if len(held) >= self.needed[t] and first < n and not any(t in alone.get(k, ()) for k in range(first, n + 1)):
                    spans.append((first, n, t, len(held) / self.sizes[t]))
        runs: list[tuple[int, int, dict[int, float]]] = []
        for first, last, t, c in sorted(spans):
            if runs and first <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(last, runs[-1][1]), runs[-1][2])
            else:
                runs.append((first, last, {}))
            runs[-1][2][t] = max(c, runs[-1][2].get(t, 0.0))
        return [(a, b, sorted(found.items())) for a, b, found in runs]

    def blocks(self, data: bytes) -> list[tuple[int, int, list[tuple[int, float]]]]:
        """(first line, last line, matches) of a text's lines and runs of lines with a match."""
        lines = [words(line) for line in data.split(b"\n")]
        own = {n: found for n, line in enumerate(lines) if (found := self.matches(set(line)))}
        return sorted([(n, n, found) for n, found in own.items()] + self.wrapped(lines, own))


def explained(sets: list[set], needed: list[int]) -> set[tuple[int, int]]:
    """Pairs (t, u) of templates so alike that any block holding all of ``u`` also reaches ``t``'s threshold."""
    return {(t, u) for t, a in enumerate(sets) for u, b in enumerate(sets) if t != u and len(a & b) >= needed[t]}


def best(hits: list[tuple[int, float]], pairs: set[tuple[int, int]], sizes: list[int]) -> list[tuple[int, float]]:
    """A block's templates without those that a better match of a like template explains.

    So one that names a variant (by-nc) isn't taken for the plain license as well.
    """
    worth = {t: (c, sizes[t], -t) for t, c in hits}
    return [(t, c) for t, c in hits if not any((t, u) in pairs and worth[u] > worth[t] for u in worth)]


def template_counts(df: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[bytes, int]:
    """For each word of the templates, the number of blocks (lines) of all texts that hold it."""
    _common.ship(df.sparkSession)
    universe = frozenset(w for _, t in templates for w in words(t.encode()))

    def run(batches):
        total = Counter()
        for batch in _common.slices(batches, "data"):
            for data in batch.column("data").to_pylist():
                if universe.isdisjoint(words(data)):
                    continue
                for line in data.split(b"\n"):
                    total.update(universe.intersection(words(line)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = df.select(_common.text_bytes(text).alias("data")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # at most a row for each word of the templates


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that holds a template: (id, block, label, template, containment, block_text).

    ``block`` is the (first) line's number from 0, ``template`` the number in ``templates``.
    """
    index = Index(templates, template_counts(df, text, templates), threshold)
    source = df.select(F.col(id_column).alias("id"), _common.text_bytes(text).alias("data"))

    def run(batches):
        for batch in _common.slices(batches, "data"):
            rows = []
            for key, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if index.prefix_words.isdisjoint(words(data)):
                    continue
                lines = data.split(b"\n")
                for first, last, found in index.blocks(data):
                    block = b"\n".join(lines[first : last + 1]).decode(errors="replace")
                    rows += [(key, first, index.labels[t], t, c, block) for t, c in found]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.int32()), pa.array(columns[4]), pa.array(columns[5])], names=["id", "block", "label", "template", "containment", "block_text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, block long, label string, template int, containment double, block_text string").withColumnRenamed("id", id_column)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Phrases and template matches of every document.

    ``score`` is the largest containment found (0: none), ``n_blocks`` counts the blocks with a match.
    """
    df = _common.read(spark, sf_dir, "documents")
    index = Index(TEMPLATES, template_counts(df), THRESHOLD)
    phrase_words = {p.split()[-1] for p, _ in PHRASES}

    def run(batches):
        for batch in _common.slices(batches, "data"):
            rows = []
            for data in batch.column("data").to_pylist():
                found = words(data)
                places = phrase_places(found) if not phrase_words.isdisjoint(found) else []
                blocks = 0
                labels = base = {label for _, label in places}
                score = 0.0
                if not index.prefix_words.isdisjoint(found):
                    for _, _, hits in index.blocks(data):
                        blocks += 1
                        labels = labels | {index.labels[t] for t, _ in best(hits, index.explained, index.sizes)}
                        score = max(score, *(c for _, c in hits))
                rows.append((len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col("doc_id").cast("long"), _common.text_bytes().alias("data")).mapInArrow(run, SCHEMA)


def _sql() -> str:
    sets = [(label, sorted({w.decode() for w in words(t.encode())})) for label, t in TEMPLATES]
    needed = [math.ceil(THRESHOLD * len(s) - 1e-9) for _, s in sets]
    pairs = ", ".join(f"({t}, {u})" for t, u in sorted(explained([set(s) for _, s in sets], needed)))
    rows = ", ".join(f"({i}, '{label}', {len(s)}, {math.ceil(THRESHOLD * len(s) - 1e-9)}, [{', '.join(map(repr, s))}])" for i, (label, s) in enumerate(sets))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = " UNION ALL ".join(
        f"SELECT r, i - {len(p.split()) - 1} AS place, '{label}' AS label FROM pos WHERE " + " AND ".join(f"w[i + {1 - k}] = '{part}'" for k, part in enumerate(reversed(p.decode().split())) ) + f" AND i >= {len(p.split()) - 1}"
        for p, label in PHRASES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, {lower} AS t FROM d),
a AS (SELECT r, doc_id, t, regexp_extract_all(t, '{pattern}') AS w FROM l),
pos AS (SELECT r, w, unnest(range(len(w))) AS i FROM a WHERE list_contains(w, 'license')),
hits AS ({phrases}),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM hits GROUP BY r),
tpl(id, label, size, needed, ws) AS (VALUES {rows}),
lines AS (SELECT r, row_number() OVER () AS b, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM a)),
tok AS (SELECT DISTINCT r, b, unnest(regexp_extract_all(line, '{pattern}')) AS w FROM lines),
tw AS (SELECT id, label, size, needed, unnest(ws) AS w FROM tpl),
x(t, u) AS (VALUES {pairs}),
m AS (SELECT r, b, id, label, size, count(*) / size AS c FROM tok JOIN tw USING (w) GROUP BY r, b, id, label, size, needed HAVING count(*) >= needed),
less AS (SELECT m.b, m.id FROM m JOIN x ON m.id = x.t JOIN m AS o ON o.b = m.b AND o.id = x.u WHERE (o.c, o.size, -o.id) > (m.c, m.size, -m.id)),
sim AS (SELECT r, max(c) AS score, list(DISTINCT label) FILTER ((b, id) NOT IN (SELECT (b, id) FROM less)) AS ls, count(DISTINCT b) AS n_blocks FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(sim.ls, [])))), ','), '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM a LEFT JOIN base USING (r) LEFT JOIN sim USING (r)
"""


ORACLE_SQL = _sql()
