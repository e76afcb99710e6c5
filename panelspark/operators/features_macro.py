"""Macro vintages and market-state features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clip
from panelspark.functions.windows import DATE, ID, in_order, rolling
from panelspark.operators.asof import as_of_dates


def select_vintages(macro: DataFrame, series: Sequence[str]) -> DataFrame:
    """All vintages of the series; which one counts is decided when they are joined."""
    return macro.where(F.col("series_id").isin(list(series)))


def macro_as_of(dates: DataFrame, macro: DataFrame, series: Sequence[str]) -> DataFrame:
    """(as_of, a column a series): the latest vintage known at midnight of the date."""
    return as_of_dates(dates, macro, "series_id", "available_at", "value", series)


def benchmark_regime(benchmark: DataFrame) -> DataFrame:
    """Volatility over 21 and 63 rows, trend over 126, drawdown from the 252-row peak. One row a date."""
    df = benchmark.select(DATE, "close", F.lit(1).alias("_k"))
    w = in_order("_k")
    df = df.withColumn("_r", F.ln("close") - F.lag(F.ln("close")).over(w))
    year = F.sqrt(F.lit(252.0))
    roll = lambda agg, x, n, m: rolling(agg, x, n, m, "_k")
    peak = roll(F.max, F.col("close"), 252, 60)
    return df.select(
        F.col(DATE).alias("as_of"), (roll(F.stddev_samp, F.col("_r"), 21, 15) * year).alias("market_vol_21d"), (roll(F.stddev_samp, F.col("_r"), 63, 40) * year).alias("market_vol_63d"),
        (F.ln("close") - F.lag(F.ln("close"), 126).over(w)).alias("market_trend_126d"), (F.col("close") / peak - 1).alias("market_drawdown"))


def market_state(prices: DataFrame) -> DataFrame:
    """Breadth, dispersion of 21-row returns and the average-correlation proxy: aggregates by date, then one window over dates."""
    w = in_order()
    p = F.col("adjusted_close")
    mean50 = rolling(F.avg, p, 50, 30)
    df = prices.select(ID, DATE, (p > mean50).cast("double").alias("_up"), (F.ln(p) - F.lag(F.ln(p), 21).over(w)).alias("_r21"), (F.ln(p) - F.lag(F.ln(p)).over(w)).alias("_r"))
    by = df.groupBy(DATE).agg(F.avg("_up").alias("market_breadth"), F.stddev_samp("_r21").alias("cross_sectional_dispersion"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"))
    by = by.withColumn("_c", clip(F.abs("_m") / (F.col("_s") + 1e-9), 0.0, 10.0)).withColumn("_k", F.lit(1))
    return by.select(F.col(DATE).alias("as_of"), "market_breadth", "cross_sectional_dispersion", rolling(F.avg, F.col("_c"), 21, 10, "_k").alias("average_correlation"))


def macro_features(panel: DataFrame, names: Mapping[str, str], key: str = ID, day: str = "as_of") -> DataFrame:
    """yield_curve_slope, growth_change, inflation_change and real_rate_proxy from columns of as-of values.

    ``names`` maps the roles long_rate, short_rate, growth, inflation to columns; changes
    are over 252 rows of a security's panel, so their span follows the panel's frequency.
    """
    w = Window.partitionBy(key).orderBy(day)
    out = {}
    if {"long_rate", "short_rate"} <= names.keys():
        out["yield_curve_slope"] = F.col(names["long_rate"]) - F.col(names["short_rate"])
    for role in ("growth", "inflation"):
        if role in names:
            before = F.lag(names[role], 252).over(w)
            out[f"{role}_change"] = F.try_divide(F.col(names[role]) - before, before)
    df = panel.withColumns(out)
    if {"long_rate", "inflation"} <= names.keys():
        df = df.withColumn("real_rate_proxy", F.col(names["long_rate"]) / 100 - F.col("inflation_change"))
    return df
