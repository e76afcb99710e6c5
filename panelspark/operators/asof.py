"""Point-in-time joins: as-of by key and without one, interval joins, last row before a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, known: str, order: Sequence[str] = (), strict: bool = False, prefix: str = "") -> DataFrame:
    """Each left row with the latest right row of its key with ``known`` <= ``at`` (< if strict).

    A union of both sides and one running ``last`` over (key, time): one exchange, no row
    multiplication.  Dates are compared as midnight.  Ties of ``known`` fall to the largest
    values of ``order``.  Left rows without a match have nulls; right rows without a key
    or time match nothing.
    """
    cols = [c for c in right.columns if c != key]
    clash = [c for c in cols if prefix + c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}; give a prefix")
    payload = F.struct(*[F.col(c) for c in cols])
    l = left.select(F.col(key).alias("_k"), F.col(at).cast("timestamp").alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    r = right.where(F.col(known).isNotNull() & F.col(key).isNotNull())
    r = r.select(F.col(key).alias("_k"), F.col(known).cast("timestamp").alias("_t"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    both = l.unionByName(r)
    is_left = F.col("_l").isNotNull()
    # at the same instant a filing comes before the row that may see it, after it if strict
    side = F.when(is_left, 0 if strict else 1).otherwise(1 if strict else 0)
    w = Window.partitionBy("_k").orderBy("_t", side, *[F.col(f"_r.{c}").asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(is_left)
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(prefix + c) for c in cols])


def validity(vintages: DataFrame, key: str, known: str, order: Sequence[str] = ()) -> DataFrame:
    """Each vintage with [valid_from, valid_to): until the next one of its key is known."""
    w = Window.partitionBy(key).orderBy(known, *order)
    nxt = F.lead(known).over(w)
    return vintages.where(F.col(known).isNotNull()).withColumn("valid_from", F.col(known)).withColumn("valid_to", nxt)


def as_of_dates(dates: DataFrame, vintages: DataFrame, key: str, known: str, value: str, names: Sequence[str], day: str = "as_of", order: Sequence[str] = ("observation_date", "revision_id")) -> DataFrame:
    """For each distinct date a column a series: the value of its latest vintage known at midnight of that date.

    Each date asks for each of the named series, so dates and vintages meet in one as-of
    join by series and no date is compared with every vintage.
    """
    asked = dates.select(day).distinct().withColumn(key, F.explode(F.array(*[F.lit(n) for n in names])))
    known_rows = vintages.where(F.col(key).isin(list(names))).select(key, F.col(known).alias("_known"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).alias("_value"))
    met = as_of_join(asked, known_rows, key, day, "_known", [f"_o{i}" for i in range(len(order))])
    return met.groupBy(day).pivot(key, list(names)).agg(F.first("_value"))


def interval_join(left: DataFrame, right: DataFrame, on: str, day: str, start: str = "start_date", end: str = "end_date", known: str | None = None, how: str = "inner") -> DataFrame:
    """Rows of the same key whose half-open interval [start, end) holds the day and, if asked, that were known by its end."""
    r = right.withColumnRenamed(on, "_k")
    cond: Column = (F.col(on) == F.col("_k")) & (F.col(start) <= F.col(day)) & (F.col(end).isNull() | (F.col(day) < F.col(end)))
    if known:
        cond &= F.col(known).isNull() | (F.col(known) < F.date_add(F.col(day), 1).cast("timestamp"))
    return left.join(r, cond, how).drop("_k")
