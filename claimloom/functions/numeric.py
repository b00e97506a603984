"""Rounding and averages that give the same bits on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Round a double half away from zero; the integer floor keeps ``-0.0`` out.

    From 2^53 steps on, a double has no finer places and stays.
    """
    scale = float(10**places)
    rounded = F.when(value >= 0, F.lit(1)).otherwise(F.lit(-1)) * F.floor(F.abs(value) * scale + 0.5) / F.lit(scale)
    return F.when(F.abs(value) * scale >= float(2**53), value.cast("double")).otherwise(rounded)


def exact_sum(amount: Column) -> Column:
    """Sum of a decimal amount as a double: exact whatever order partials merge in."""
    return F.sum(amount).cast("double")


def exact_avg(amount: Column, places: int | None = None) -> Column:
    """Mean of the non-null decimal amounts; NULL for an empty group."""
    mean = F.try_divide(exact_sum(amount), F.count(amount))
    return mean if places is None else half_up(mean, places)


def percent(part: Column, whole: Column, places: int) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return half_up(F.try_divide(part * F.lit(100.0), whole), places)


def ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """Rounded quotient of two amounts; NULL when either is missing or the divisor is zero."""
    return half_up(F.try_divide(numerator.cast("double"), denominator.cast("double")), places)


def thousands(amount: Column) -> Column:
    """Whole number with comma separators, as the display texts show money."""
    return F.format_number(amount.cast("double"), 0)
