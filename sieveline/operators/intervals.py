"""Joining spans that overlap, without comparing all of a text's spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans

#: Widths of the bins of each level. Longer spans are in several bins of the last.
WIDTHS = tuple(64**k for k in range(1, 7))
#: Columns of the join itself, by names that no table of this library has.
_LEFT, _RIGHT, _LEVEL, _BIN = "overlapping left", "overlapping right", "overlapping level", "overlapping bin"


def _bins(start: Column, end: Column, widths: tuple[int, ...]) -> Column:
    """The bins that a span is in: at its own level, the first whose bins are as wide as it, and at all wider ones."""
    length, last, each = end - start, F.greatest(start, end - 1), []
    bin_ = lambda place, width: F.floor(place / F.lit(width)).cast("bigint")
    for n, width in enumerate(widths):
        fits = F.lit(True) if n == len(widths) - 1 else length <= width
        own = fits & (length > widths[n - 1]) if n else fits
        entry = F.struct(F.lit(n).alias("level"), bin_(start, width).alias("first"), bin_(last, width).alias("last"), own.alias("own"))
        each.append(F.when(fits, entry))
    levels = F.array_compact(F.array(*each))
    at = lambda x: F.transform(F.sequence(x["first"], x["last"]), lambda b: F.struct(x["level"].alias("level"), b.alias("bin"), x["first"].alias("first"), x["own"].alias("own")))
    return F.when(start.isNotNull() & end.isNotNull(), F.flatten(F.transform(levels, at)))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """All pairs of rows with equal ``on`` whose spans overlap, each once: ``on``, the left columns, then the right ones.

    An equi-join on bins: a span is in the bins of its own level and of wider
    ones, two of each at most, and pairs are made at the level of the longer
    span. So spans of one key are spread over its bins, and a long span has few
    copies. ``widths`` change the cost alone; with one width a span has a copy
    for each bin that it touches.

    Spans are half-open; an empty one counts as the character at its place. A
    null key, start or end has no partner; repeated rows pair as often as they
    are there. Besides ``on`` the two must not share a column.
    """
    keys = {c.lower() for c in on}
    shared = ({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - keys
    if shared:
        raise ValueError(f"both sides have {', '.join(sorted(shared))}")
    (start, end), (start2, end2) = ((F.col(a), F.when(F.col(b).isNotNull(), F.greatest(F.col(b), F.col(a) + 1))) for a, b in (left_span, right_span))
    placed = lambda df, bins, name: df.select("*", F.explode(bins).alias(name)).select("*", F.col(name)["level"].alias(_LEVEL), F.col(name)["bin"].alias(_BIN))
    one, two = placed(left, _bins(start, end, widths), _LEFT), placed(right, _bins(start2, end2, widths), _RIGHT)
    mine, its = F.col(_LEFT), F.col(_RIGHT)
    once = (mine["own"] | its["own"]) & (F.greatest(mine["first"], its["first"]) == F.col(_BIN))
    joined = one.join(two, [*on, _LEVEL, _BIN]).where(once & (start < end2) & (start2 < end))
    return joined.select(*on, *(c for c in left.columns if c.lower() not in keys), *(c for c in right.columns if c.lower() not in keys))


def line_spans(text: Column) -> Column:
    """A text's lines, each with its end: ``array<struct<line_no, line_start, line_end>>``, counted from 1; of an empty or null text none."""
    lines = spans.java_spans(text, r"[^\n]*+\n|[^\n]++")
    return F.transform(lines, lambda x, n: F.struct((n + 1).alias("line_no"), x["start"].alias("line_start"), x["end"].alias("line_end")))
