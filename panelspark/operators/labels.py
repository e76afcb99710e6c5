"""Forward labels: delayed benchmark-relative returns with delisting handling, ranked by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID, average_rank, carried, in_order


def on_calendar(prices: DataFrame, days: DataFrame, value: str = "adjusted_close") -> DataFrame:
    """A row for each security and session, ``value`` carried forward from its last bar; null before the first."""
    ids = prices.select(ID).distinct()
    grid = ids.crossJoin(F.broadcast(days.select(DATE).distinct()))  # sessions: a few thousand rows
    out = grid.join(prices.select(ID, DATE, value), [ID, DATE], "left")
    return out.withColumn(value, carried(F.col(value)))


def _every_session(prices: DataFrame, cal: DataFrame, delay: int, horizon: int) -> DataFrame:
    """Entry and exit prices for each security and session."""
    grid = on_calendar(prices, cal)
    own = in_order()
    grid = grid.withColumns({"_in": F.lead("adjusted_close", delay).over(own), "_out": F.lead("adjusted_close", delay + horizon).over(own)})
    return grid.drop("adjusted_close").join(F.broadcast(cal), DATE)  # a row a session


def _at_signals(prices: DataFrame, cal: DataFrame, signal_dates: DataFrame) -> DataFrame:
    """Entry and exit prices for each security and signal date: two lookups each in the security's bars, by one sorted merge.

    The merge holds the bars and twice the signals; nothing is filled in for the sessions between.
    """
    signals = cal.join(signal_dates.select(F.col("as_of").alias(DATE)).distinct(), DATE, "left_semi").where("window_start IS NOT NULL AND window_end IS NOT NULL")
    bars = prices.where(F.col("adjusted_close").isNotNull()).join(F.broadcast(cal.select(DATE)), DATE, "left_semi")
    none = F.lit(None)
    held = bars.select(ID, F.col(DATE).alias("_t"), "adjusted_close", none.cast("boolean").alias("_exit"), none.cast("date").alias(DATE))
    ask = F.explode(F.array(F.struct(F.col("window_start").alias("t"), F.lit(False).alias("x")), F.struct(F.col("window_end").alias("t"), F.lit(True).alias("x")))).alias("_a")
    asked = prices.select(ID).distinct().crossJoin(F.broadcast(signals.select(DATE, ask)))  # two rows a signal date
    both = held.unionByName(asked.select(ID, F.col("_a.t").alias("_t"), none.cast("double").alias("adjusted_close"), F.col("_a.x").alias("_exit"), DATE))
    w = in_order(ID, "_t").orderBy("_t", F.col("_exit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_p", F.last("adjusted_close", ignorenulls=True).over(w)).where("_exit IS NOT NULL")
    at = met.groupBy(ID, DATE).agg(F.max(F.when(~F.col("_exit"), F.col("_p"))).alias("_in"), F.max(F.when(F.col("_exit"), F.col("_p"))).alias("_out"))
    return at.join(F.broadcast(signals), DATE)


def forward_labels(prices: DataFrame, benchmark: DataFrame, securities: DataFrame, horizon: int = 21, delay: int = 1, signal_dates: DataFrame | None = None) -> DataFrame:
    """(security_id, as_of, window_start, window_end, raw_return, benchmark_return, excess_return, is_delisted, excess_rank, outperform).

    A signal at row t is entered ``delay`` sessions later and left ``horizon`` after that.
    A security that dies inside its window earns the price return up to its last session
    compounded with its delisting return (null is -100%), and the window ends at its
    death; rows after the death have no label.  Ranks are average rank / n by date.
    With ``signal_dates`` (as_of) only these are labelled, and the work follows them and the bars.
    """
    b = benchmark.select(DATE, F.col("close").alias("_b"))
    w = in_order("_k", DATE)
    ahead = lambda c, n: F.lead(c, n).over(w)
    cal = b.withColumn("_k", F.lit(1))
    cal = cal.withColumns({"window_start": ahead(DATE, delay), "window_end": ahead(DATE, delay + horizon), "benchmark_return": F.try_divide(ahead("_b", delay + horizon), ahead("_b", delay)) - 1})
    cal = cal.select(DATE, "window_start", "window_end", "benchmark_return")
    rows = _every_session(prices, cal, delay, horizon) if signal_dates is None else _at_signals(prices, cal, signal_dates)
    rows = rows.join(securities.select(ID, "delisting_date", "delisting_return"), ID, "left")
    dead = F.col("delisting_date")
    dies = dead.isNotNull() & (dead > F.col(DATE)) & (dead <= F.col("window_end"))
    price_return = F.try_divide(F.col("_out"), F.col("_in")) - 1
    booked = (1 + F.coalesce(price_return, F.lit(0.0))) * (1 + F.coalesce("delisting_return", F.lit(-1.0))) - 1
    rows = rows.withColumns({
        "is_delisted": F.coalesce(dies, F.lit(False)),
        "raw_return": F.when(dies, booked).otherwise(price_return),
        "window_end": F.when(dies, F.greatest(dead, F.least("window_start", dead))).otherwise(F.col("window_end")),
        "window_start": F.when(dies, F.least("window_start", dead)).otherwise(F.col("window_start")),
    })
    rows = rows.where(dead.isNull() | (F.col(DATE) < dead))
    rows = rows.withColumn("excess_return", F.col("raw_return") - F.col("benchmark_return"))
    rows = rows.where(F.col("excess_return").isNotNull() & F.col("window_start").isNotNull() & F.col("window_end").isNotNull())
    rows = rows.withColumnRenamed(DATE, "as_of")
    return ranked(rows).select(ID, "as_of", "window_start", "window_end", "raw_return", "benchmark_return", "excess_return", "is_delisted", "excess_rank", "outperform")


def ranked(labels: DataFrame) -> DataFrame:
    """excess_rank in (0, 1] by date with ties averaged, and outperform as 1.0 or 0.0."""
    n = F.count("excess_return").over(Window.partitionBy("as_of"))
    return labels.withColumns({"excess_rank": average_rank(F.col("excess_return"), "as_of") / n, "outperform": (F.col("excess_return") > 0).cast("double")})
