"""Scalar expressions as SQL text, for Spark and for the engine that checks it.

Rules in ``text`` and ``math`` are written once, over these few primitives; ``SPARK`` gives the
text that the operators run, ``DUCK`` that of the check, whose primitives differ in regular
expressions (Java and RE2), lambdas and list functions.
"""

from __future__ import annotations

import re


class Dialect:
    """Spark SQL."""

    def lit(self, s: str) -> str:
        if "'" not in s:
            return f"r'{s}'"
        return f'r"{s}"'

    def test(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        r"""Replace all matches; ``by`` names groups as \1."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'\\(\d)', r'$\1', by))})"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)"

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        """The first match's group, or ''."""
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def split(self, x: str, separator: str) -> str:
        return f"split({x}, {self.lit(separator)})"

    def map(self, xs: str, v: str, body: str) -> str:
        return f"transform({xs}, {v} -> {body})"

    def imap(self, xs: str, v: str, i: str, body: str) -> str:
        """``i`` counts from 0."""
        return f"transform({xs}, ({v}, {i}) -> {body})"

    def keep(self, xs: str, v: str, body: str) -> str:
        return f"filter({xs}, {v} -> {body})"

    def let(self, x: str, v: str, body: str) -> str:
        """``body`` with ``v`` standing for ``x``, which is computed once."""
        return f"get(transform(array({x}), {v} -> {body}), 0)"

    def fold(self, xs: str, start: str, acc: str, v: str, body: str) -> str:
        return f"aggregate({xs}, {start}, ({acc}, {v}) -> {body})"

    def get(self, xs: str, i: str) -> str:
        return f"get({xs}, CAST({i} AS INT))"

    def size(self, xs: str) -> str:
        return f"CAST(size({xs}) AS BIGINT)"

    def join(self, xs: str, separator: str) -> str:
        return f"array_join({xs}, {separator})"

    def some(self, xs: str, v: str, body: str) -> str:
        return f"exists({xs}, {v} -> {body})"

    def length(self, x: str) -> str:
        return f"CAST(char_length({x}) AS BIGINT)"

    def starts(self, x: str, prefix: str) -> str:
        return f"startswith({x}, {prefix})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def cat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def part(self, x: str, start: str, length: str) -> str:
        """``start`` counts from 1."""
        return f"substring({x}, CAST({start} AS INT), CAST({length} AS INT))"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


class Duck(Dialect):
    """DuckDB SQL."""

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def test(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def split(self, x: str, separator: str) -> str:
        return f"string_split({x}, {self.lit(separator)})"

    def map(self, xs: str, v: str, body: str) -> str:
        return f"list_transform({xs}, lambda {v}: {body})"

    def imap(self, xs: str, v: str, i: str, body: str) -> str:
        return f"list_transform({xs}, lambda {v}, {i}_: {re.sub(rf'\b{i}\b', f'({i}_ - 1)', body)})"

    def keep(self, xs: str, v: str, body: str) -> str:
        return f"list_filter({xs}, lambda {v}: {body})"

    def let(self, x: str, v: str, body: str) -> str:
        return f"(list_transform([{x}], lambda {v}: {body})[1])"

    def fold(self, xs: str, start: str, acc: str, v: str, body: str) -> str:
        return f"list_reduce({xs}, lambda {acc}, {v}: {body}, {start})"

    def get(self, xs: str, i: str) -> str:
        return f"({xs})[({i}) + 1]"

    def size(self, xs: str) -> str:
        return f"CAST(len({xs}) AS BIGINT)"

    def join(self, xs: str, separator: str) -> str:
        return f"array_to_string({xs}, {separator})"

    def some(self, xs: str, v: str, body: str) -> str:
        return f"(len(list_filter({xs}, lambda {v}: {body})) > 0)"

    def length(self, x: str) -> str:
        return f"CAST(length({x}) AS BIGINT)"

    def starts(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, {prefix})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def part(self, x: str, start: str, length: str) -> str:
        return f"substring({x}, CAST({start} AS BIGINT), CAST({length} AS BIGINT))"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


SPARK, DUCK = Dialect(), Duck()
