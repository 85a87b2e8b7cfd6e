"""Positions of pattern matches with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` what lies between them; running totals of their lengths, in code
points, are the places.  Totals are taken in steps of 64, so a text with very many matches costs little more than
their number.  Patterns with runs use possessive repeats and start only where a run starts, so that no text takes a
time that grows with the square of a run; what they match stays the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 64
FOUND = "array<struct<start: int, end: int, text: string, before: string>>"
SPANS = "array<struct<start: int, ord: int, end: int, kind: string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(steps: Column, op: Callable[[Column, Column], Column] = plus, zero: int = 0) -> Column:
    """Running totals (or maxima, minima: ``op`` and its neutral ``zero``) of an array of ints, which is not empty."""

    def fold(some: Column) -> Column:
        return F.aggregate(some, F.lit(zero), op)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STEP).cast("int")), lambda b: fold(F.slice(steps, b * STEP + 1, F.lit(STEP))))
    starts = let(chunks, lambda c: F.transform(c, lambda _, b: fold(F.slice(c, F.lit(1), b))))
    return let(starts, lambda s: F.transform(steps, lambda _, i: op(s[F.floor(i / STEP).cast("int")], fold(F.slice(steps, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1)))))


def located(text: Column, matches: Column, pattern: str, context: int = 0) -> Column:
    """The matches with start, end (exclusive) and the last ``context`` characters before them, as ``FOUND``."""

    def place(gaps: Column) -> Column:
        steps = F.transform(matches, lambda _, i: F.length(gaps[i]) + F.when(i > 0, F.length(matches[i - 1])).otherwise(0))
        return let(let(steps, lambda x: running(x)), lambda at: F.transform(matches, lambda m, i: F.struct(at[i].alias("start"), (at[i] + F.length(m)).alias("end"), m.alias("text"), (F.right(gaps[i], F.lit(context)) if context else F.lit("")).alias("before"))))

    none = F.array().cast(FOUND)
    return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), place).cast(FOUND)).otherwise(none)


def of_kind(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPANS)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in its order, then end; comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(numerals: Column) -> Column:
    """Do the digits pass the Luhn check?"""
    n = F.length(numerals)

    def worth(i: Column) -> Column:
        d = F.substring(numerals, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0
