"""Rounding rules shared by all geometry, spelled as built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """Nearest whole number, ties to even (a JVM intrinsic, still a double)."""
    return F.rint(c)


def toward_zero(c: Column) -> Column:
    return c.cast("bigint")


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def halve(c: Column) -> Column:
    """Whole half of a non-negative integer column."""
    return F.shiftright(c.cast("bigint"), 1)


def clamp(c: Column, low: Column, high: Column) -> Column:
    """Lower bound wins over upper bound, as ``max(low, min(c, high))``."""
    return F.greatest(low, F.least(c, high))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda that captures an outer expression has it inlined by the optimizer
    and recomputed for every array element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Add columns in stages so later ones may name earlier ones.

    Underscored names of all stages but the last are temporaries and are dropped.
    """
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*[n for stage in stages[:-1] for n in stage if n.startswith("_")])
