"""Rounding rules that differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(value.cast("double") + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal, halves to even; null when whole is 0."""
    return F.when(whole != 0, F.bround(part / whole * F.lit(100.0), 1))


def total_or_null(value: Column) -> Column:
    """Sum that is null as soon as one value is: an unmeasured part leaves the whole unmeasured."""
    return F.when(F.count("*") == F.count(value), F.sum(value))
