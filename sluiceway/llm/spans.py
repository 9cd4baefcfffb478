"""Spans of regular expressions in whole texts, by built-in expressions only.

A span is struct<s: int, e: int, x: string, g: string>: start, end (exclusive) in code points, the
matched text and one of its groups. Starts are running sums over the lengths of the matches and of
the pieces between them; the sums run in chunks, so a text with very many matches stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256
TYPE = "array<struct<s: int, e: int, x: string, g: string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(lengths: Column, start: Column) -> Column:
    zero = F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
    return F.aggregate(lengths, zero, step, lambda a: a["out"])


def sums_before(lengths: Column) -> Column:
    """For each element of array<int>, the sum of the elements before it."""

    def by_chunk(a: Column) -> Column:
        n_chunks = F.greatest(F.floor((F.size(a) + _CHUNK - 1) / _CHUNK).cast("int"), F.lit(1))
        chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda j: F.slice(a, j * _CHUNK + 1, _CHUNK))
        return let(chunks, lambda c: let(
            _scan(F.transform(c, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)), F.lit(0)),
            lambda bases: F.flatten(F.transform(c, lambda part, j: _scan(part, F.get(bases, j))))))

    return let(lengths, by_chunk)


def matches(text: Column, pattern: str, group: int = 0, when: Column | None = None) -> Column:
    """All leftmost non-overlapping matches; ``when`` is a cheap test that holds wherever the pattern can match."""
    some = text.rlike(pattern) if when is None else when & text.rlike(pattern)
    p = F.lit(pattern)

    def found(t: Column) -> Column:
        both = F.struct(
            F.regexp_extract_all(t, p, F.lit(0)).alias("x"),
            F.regexp_extract_all(t, p, F.lit(group)).alias("g"),
            F.transform(F.split(t, pattern, -1), lambda gap: F.length(gap)).alias("gaps"),
        )

        def placed(b: Column) -> Column:
            lengths = F.transform(b["x"], lambda m, i: F.length(m) + F.get(b["gaps"], i + 1))
            return let(sums_before(lengths), lambda before: F.transform(b["x"], lambda m, i: F.struct(
                (F.get(before, i) + F.get(b["gaps"], F.lit(0))).alias("s"),
                (F.get(before, i) + F.get(b["gaps"], F.lit(0)) + F.length(m)).alias("e"),
                m.alias("x"), F.get(b["g"], i).alias("g"))))

        return let(both, placed)

    return F.coalesce(F.when(some, let(text, found)), F.array().cast(TYPE))


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """Sortable spans: struct<s, o, e, kind>."""
    return F.transform(spans, lambda m: F.struct(m["s"].alias("s"), F.lit(order).alias("o"), m["e"].alias("e"), F.lit(kind).alias("kind")))


def described(spans: Column) -> Column:
    """``kind:start:end`` by start and then by the kinds' order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each struct<s, e, by> of an array sorted by s put in place; a span that starts within an earlier one is left out."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, m["s"] - a["at"]), m["by"])
        return F.when(m["s"] < a["at"], a).otherwise(F.struct(m["e"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out")))

    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(spans, first, step, rest)
