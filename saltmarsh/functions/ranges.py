"""Positions and ranges (1-based lines and characters, ends included), spans and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_WEIGHT = 1_000_000


def to_wire(x: Column) -> Column:
    """1-based to 0-based, never below 0."""
    return F.greatest(x - 1, F.lit(0))


def from_wire(x: Column) -> Column:
    return x + 1


def contains(sl: Column, sc: Column, el: Column, ec: Column, line: Column, char: Column) -> Column:
    """Whether the closed range holds the position."""
    return ((sl < line) | ((sl == line) & (sc <= char))) & ((line < el) | ((line == el) & (char <= ec)))


def range_in(sl: Column, sc: Column, el: Column, ec: Column, osl: Column, osc: Column, oel: Column, oec: Column) -> Column:
    return contains(osl, osc, oel, oec, sl, sc) & contains(osl, osc, oel, oec, el, ec)


def span(sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    """Lines weigh a million columns; columns that run backwards count as none."""
    return (F.greatest(el - sl, F.lit(0)) * LINE_WEIGHT + F.greatest(ec - sc, F.lit(0))).cast("long")


def distance(sl: Column, sc: Column, el: Column, ec: Column, line: Column, char: Column) -> Column:
    """From a position to a range: 0 inside, else to the nearer end, lines weighing a million columns."""
    before = (line < sl) | ((line == sl) & (char < sc))
    after = (line > el) | ((line == el) & (char > ec))
    near = lambda a, b, x, y: F.abs(a - b) * LINE_WEIGHT + F.abs(x - y)
    return F.when(before, near(sl, line, sc, char)).when(after, near(line, el, char, ec)).otherwise(0).cast("long")


def selection_positions(chain: Column) -> Column:
    """Distinct start and last positions up a chain of ranges, an array of struct(sl, sc, el, ec), in order."""
    two = F.transform(chain, lambda r: F.array(F.struct(r["sl"].alias("line"), r["sc"].alias("char")), F.struct(r["el"].alias("line"), F.greatest(r["ec"] - 1, F.lit(0)).alias("char"))))
    return F.array_distinct(F.flatten(two))


def backoff(base: float, factor: float, attempt: Column, cap: float) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt), F.lit(float(cap)))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
