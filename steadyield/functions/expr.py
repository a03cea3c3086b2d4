"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(c: Column) -> Column:
    """SQL's IS TRUE: null counts as false."""
    return F.coalesce(c, F.lit(False))


def distinct_from(a: Column, b) -> Column:
    """SQL's IS DISTINCT FROM."""
    return ~a.eqNullSafe(F.lit(b) if not isinstance(b, Column) else b)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def pick(value: str | Column, condition: Column) -> Column:
    """The largest value among the rows where the condition holds: a pivot of one cell."""
    return F.max(F.when(condition, F.col(value) if isinstance(value, str) else value))


def in_time_order(time: str, value: str) -> Column:
    """Values as an array by rising time, nulls kept in their places."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))), lambda x: x["v"])


def cagr_percent(latest: Column, oldest: Column, years: int = 4) -> Column:
    """Compound growth a year in percent, to six places."""
    return F.round((F.pow(latest.cast("double") / oldest.cast("double"), F.lit(1.0 / years)) - 1.0) * 100.0, 6)


def money_millions(c: str) -> Column:
    return F.round(F.col(c) / 1_000_000, 2)
