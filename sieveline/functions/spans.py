"""Where a pattern matches in a text: ``array<struct<start, end, text>>``, in code points."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
NONE = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NONE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place the values up to it, merged in order; ``merge`` is associative.

    As in :func:`placed`, values are merged in blocks of the square root of
    their number first, as an array grows by being copied.
    """
    along = lambda block: F.aggregate(F.slice(block, 2, F.size(block)), F.slice(block, 1, 1), lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)))

    def over(blocks: Column) -> Column:
        bases = along(F.transform(blocks, lambda block: F.element_at(block, -1)))
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda block, n: F.when(n == 0, block).otherwise(F.transform(block, lambda x: merge(F.get(base, n - 1), x))))))

    def cut(given: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(given))).cast("int")
        blocks = let(size, lambda k: F.transform(F.sequence(F.lit(1), F.size(given), k), lambda at: along(F.slice(given, at, k))))
        return F.when(F.size(given) < 2, given).otherwise(let(blocks, over))

    return let(values, cut)


def _ends(pieces: Column) -> Column:
    """Where each of the ``pieces (gap, hit)`` ends, counted from the first one's start, after a zero."""
    return F.aggregate(pieces, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x["gap"]) + F.length(x["hit"])))


def placed(pieces: Column) -> Column:
    """The spans of all hits among ``pieces (gap, hit)``.

    The lengths of the text between matches and of the matches themselves,
    taken in turn, add up to the offsets. They are added up in blocks of the
    square root of their number: an array grows by being copied, so one fold
    over all of them would take the square of their number.
    """

    def of(blocks: Column) -> Column:
        bases = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + F.element_at(block["ends"], -1)))

        def span(piece: Column, before: Column, base: Column) -> Column:
            start = base + before + F.length(piece["gap"])
            return F.struct(start.alias("start"), (start + F.length(piece["hit"])).alias("end"), piece["hit"].alias("text"))

        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda block, n: F.transform(block["pieces"], lambda x, i: span(x, block["ends"][i], base[n])))))

    size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.size(pieces), k), lambda at: F.slice(pieces, at, k))
    return let(F.transform(let(size, cut), lambda x: F.struct(x.alias("pieces"), _ends(x).alias("ends"))), of)


def java_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, needed: str = "") -> Column:
    """Spans of a Java pattern that can't match nothing; only those whose text passes ``keep``, if given.

    ``needed`` is a text that every match holds: it is looked for first, as
    that is cheaper. A text without a match, or without one to keep, isn't
    split.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = let(hits, lambda h: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)).alias("gap"), h.alias("hit")))
    found, test = let(pieces, placed), text.rlike(pattern)
    if needed:
        test = F.contains(text, F.lit(needed)) & test
    if keep:
        found, test = F.filter(found, lambda span: keep(span["text"])), test & F.exists(hits, keep)
    return F.when(test, found).otherwise(no_spans())


def python_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a Python pattern, found by Python in Arrow batches."""
    found = re.compile(pattern)

    @F.pandas_udf(NONE)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end(), "text": m.group()} for m in found.finditer(t)])

    all_ = F.coalesce(spans(text), no_spans())
    return F.filter(all_, lambda span: keep(span["text"])) if keep else all_
