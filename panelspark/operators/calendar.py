"""Exchange sessions as a table: weekdays minus holidays given by rules, with an index for navigation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar (the anonymous Gregorian computus)."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    month, day = div(h + m - 7 * n + 114, 31), (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(year, month.cast("int"), day.cast("int"))


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th given weekday (1 = Sunday) of a month; n = -1 is the last."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n < 0:
        last = F.last_day(first)
        return F.date_sub(last, ((F.dayofweek(last) - weekday + 7) % 7).cast("int"))
    return F.date_add(first, ((weekday - F.dayofweek(first) + 7) % 7 + 7 * (n - 1)).cast("int"))


def _observed(day: Column, saturday: bool = True) -> Column:
    """A fixed holiday on a Sunday is kept on Monday, on a Saturday on Friday (if ``saturday``)."""
    w = F.dayofweek(day)
    return F.when(w == 1, F.date_add(day, 1)).when((w == 7) & F.lit(saturday), F.date_sub(day, 1)).otherwise(day)


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(holiday) of the US exchanges for a range of years."""
    y = F.col("y").cast("int")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    rules = [
        _observed(fixed(1, 1), saturday=False), F.when(y >= 1998, _nth(y, 1, 2, 3)), _nth(y, 2, 2, 3), F.date_sub(easter(y), 2), _nth(y, 5, 2, -1),
        F.when(y >= 2022, _observed(fixed(6, 19))), _observed(fixed(7, 4)), _nth(y, 9, 2, 1), _nth(y, 11, 5, 4), _observed(fixed(12, 25)),
    ]
    years = spark.range(first, last + 1).select(F.col("id").alias("y"))
    return years.select(F.explode(F.array_compact(F.array(*rules))).alias("holiday"))


def sessions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(session, idx) of every trading day in [start, end], numbered from 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("session"))
    days = days.where(~F.dayofweek("session").isin(1, 7))
    days = days.join(F.broadcast(holidays(spark, start.year, end.year + 1)), F.col("session") == F.col("holiday"), "left_anti")
    return numbered(days)


def numbered(days: DataFrame) -> DataFrame:
    """Sessions with their index; a calendar is a few thousand rows, so one ordered window does."""
    return days.withColumn("idx", F.row_number().over(Window.orderBy("session")) - 1)


def snapped(dates: DataFrame, cal: DataFrame, day: str) -> DataFrame:
    """``dates`` with idx of the session on or after the day (null after the last one)."""
    spans = cal.withColumn("_from", F.coalesce(F.date_add(F.lag("session").over(Window.orderBy("session")), 1), "session"))
    # every day of the calendar's span to its session: a row a day, met by equality
    days = spans.select("idx", F.explode(F.sequence("_from", "session")).alias("_day"))
    first = cal.agg(F.min("session").alias("_first"), F.min("idx").alias("_idx"))
    out = dates.join(F.broadcast(days), F.col(day) == F.col("_day"), "left").crossJoin(F.broadcast(first))
    return out.withColumn("idx", F.when(F.col(day) < F.col("_first"), F.col("_idx")).otherwise(F.col("idx"))).drop("_day", "_first", "_idx")


def shifted(dates: DataFrame, cal: DataFrame, day: str, n: int, name: str = "shifted") -> DataFrame:
    """The session n after the day (before, if negative); days between sessions count as the next one; null off the end."""
    at = snapped(dates, cal, day)
    to = cal.select(F.col("session").alias(name), (F.col("idx") - n).alias("_to"))
    return at.join(F.broadcast(to), F.col("idx") == F.col("_to"), "left").drop("idx", "_to")


def spanned(rows: DataFrame, cal: DataFrame, start: str, end: str, name: str = "as_of", closed: bool = False) -> DataFrame:
    """Each row with each session of [start, end) in ``name``, of [start, end] if ``closed``; a null end is open, a null start meets nothing.

    Both ends are looked up in the calendar by equality, and a row is copied only to the
    sessions that it meets.
    """
    upto = F.date_add(F.col(end).cast("date"), 1) if closed else F.col(end).cast("date")
    at = snapped(rows.withColumns({"_start": F.col(start).cast("date"), "_end": upto}), cal, "_start").withColumnRenamed("idx", "_a")
    at = snapped(at, cal, "_end").withColumnRenamed("idx", "_b")
    last = cal.agg((F.max("idx") + 1).alias("_size"))  # one row
    at = at.crossJoin(F.broadcast(last)).withColumn("_b", F.coalesce("_b", "_size")).where("_a < _b")
    at = at.withColumn("_i", F.explode(F.sequence("_a", F.col("_b") - 1)))
    days = cal.select(F.col("idx").alias("_i"), F.col("session").alias(name))  # a row a session
    return at.join(F.broadcast(days), "_i").drop("_i", "_a", "_b", "_size", "_start", "_end")


def count_between(cal: DataFrame, start: date, end: date) -> DataFrame:
    return cal.where(F.col("session").between(F.lit(start), F.lit(end))).agg(F.count("*").alias("n"))


def rebalance_dates(cal: DataFrame, rule: str) -> DataFrame:
    """(rebalance_date): ``daily``, ``weekly`` or ``weekly_first`` (last or first session of an ISO week), ``monthly`` (last of a month)."""
    s = F.col("session")
    week = (F.expr("extract(yearofweek from session)"), F.weekofyear(s))
    if rule == "daily":
        return cal.select(s.alias("rebalance_date"))
    if rule in ("weekly", "weekly_first"):
        return cal.groupBy(*week).agg((F.max(s) if rule == "weekly" else F.min(s)).alias("rebalance_date")).select("rebalance_date")
    if rule == "monthly":
        return cal.groupBy(F.trunc(s, "month")).agg(F.max(s).alias("rebalance_date")).select("rebalance_date")
    raise ValueError(f"no rule {rule!r}")
