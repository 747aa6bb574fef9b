"""Scalar building blocks on columns. Missing values are NULL everywhere; no ratio raises on zero."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b - 1, NULL if undefined."""
    return F.try_divide(a, b) - 1


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def digits(x: Column, places: int = 6) -> Column:
    """Rounded for output; never minus zero."""
    return F.round(x, places) + F.lit(0.0)


def by_session(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("sym",))).orderBy("sess")


def trailing(n: int, *keys: str) -> WindowSpec:
    """The current and the n-1 sessions before."""
    return by_session(*keys).rowsBetween(-(n - 1), 0)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, floor: float = 1e-12) -> Column:
    """Correlation from sums; NULL if a variance is not above ``floor``."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > floor) & (vy > floor), (sxy - sx * sy / n) / F.sqrt(vx * vy))


def average_rank(partition: list[str], value: str) -> Column:
    """Ranks from 1; ties share their mean. Both counts use one order, so one exchange and one sort serve them."""
    w = Window.partitionBy(*partition).orderBy(value)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (ties - 1) / 2
