"""Weighing evidence that may be absent: an observation not made drops out of the mean instead of counting as zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_mean(parts: list[tuple[Column, float]], digits: int = 4) -> Column:
    """Mean of the values present, by weight; null where none is present. Rounded half to even."""
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in parts])
    return F.bround(F.try_divide(total, F.nullif(weight, F.lit(0.0))), digits)


def year_agreement(a: Column, *others: Column) -> Column:
    """1 for the same year, 0.8 for a year apart, 0 beyond, by the nearest of the others; null where there is none to compare."""
    gaps = [F.abs(a - b) for b in others]
    gap = gaps[0] if len(gaps) == 1 else F.least(*gaps)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.8).when(gap.isNotNull(), 0.0)


def majority(condition: Column) -> Column:
    """Whether more than half of a group's rows meet the condition (an aggregate); an unknown row counts against."""
    return F.count_if(condition) * 2 > F.count(F.lit(1))


