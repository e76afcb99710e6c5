"""Window building blocks. Trailing windows count rows of one security, and give null below a minimum of non-null values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ID, DATE = "security_id", "observation_date"


def in_order(key: str = ID, order: str = DATE) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = ID, order: str = DATE) -> WindowSpec:
    return in_order(key, order).rowsBetween(1 - n, 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, least: int, key: str = ID, order: str = DATE) -> Column:
    """``agg(x)`` over the last n rows where at least ``least`` of them are not null."""
    w = trailing(n, key, order)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def rolling2(agg: Callable[[Column, Column], Column], y: Column, x: Column, n: int, least: int, key: str = ID, order: str = DATE) -> Column:
    """A two-column aggregate over rows where both are not null."""
    w = trailing(n, key, order)
    both = y.isNotNull() & x.isNotNull()
    yy, xx = F.when(both, y), F.when(both, x)
    return F.when(F.count(yy).over(w) >= least, agg(yy, xx).over(w))


def average_rank(x: Column, *by: str | Column) -> Column:
    """Rank from 1 with ties averaged; null stays null and does not count."""
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x.asc_nulls_last())) + (ties - 1) / F.lit(2.0))


def carried(x: Column, key: str = ID, order: str = DATE) -> Column:
    """The last value that is not null, up to and including the row."""
    return F.last(x, ignorenulls=True).over(in_order(key, order).rowsBetween(Window.unboundedPreceding, 0))


def change(x: Column, n: int, key: str = ID, order: str = DATE) -> Column:
    """Relative change over n rows; null where the base is zero."""
    before = F.lag(x, n).over(in_order(key, order))
    return F.try_divide(x - before, before)


def compounded(r: Column, w: WindowSpec) -> Column:
    """Running product of 1 + r as exp(sum(ln(1 + r))); 0 from the first return of -100% on."""
    return F.when(F.min(1 + r).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(1 + r)).over(w)))


def running_peak(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
