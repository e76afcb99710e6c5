"""Back-adjustment of prices for splits and dividends by suffix products: one window, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID
from panelspark.operators.asof import as_of_join


def _later(prices: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """``prices`` with ``name``: the product of the factors of events after each bar's date."""
    bars = prices.select(F.col(ID).alias("_k"), F.col(DATE).alias("_d"), F.lit(0.0).alias("_g"), F.struct(*prices.columns).alias("_p"))
    steps = events.select(F.col(ID).alias("_k"), F.col("ex_date").alias("_d"), F.ln("factor").alias("_g"), F.lit(None).cast(bars.schema["_p"].dataType).alias("_p"))
    # an event on the bar's own day is already in its price
    side = F.when(F.col("_p").isNotNull(), 1).otherwise(0)
    w = Window.partitionBy("_k").orderBy("_d", side).rowsBetween(1, Window.unboundedFollowing)
    out = bars.unionByName(steps).withColumn(name, F.exp(F.coalesce(F.sum("_g").over(w), F.lit(0.0)))).where(F.col("_p").isNotNull())
    return out.select("_p.*", name)


def split_factors(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """``split_factor``: the product of 1 / ratio over splits after the bar; ratios that are not positive are left out."""
    splits = actions.where((F.col("action_type") == "stock_split") & (F.col("value") > 0))
    return _later(prices, splits.select(ID, "ex_date", (1 / F.col("value")).alias("factor")), "split_factor")


def dividend_factors(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """``dividend_factor``: the product of 1 - dividend / last close before the ex-date, held in [1e-6, 1]."""
    cash = actions.where((F.col("action_type") == "cash_dividend") & (F.col("value") > 0)).select(ID, "ex_date", "value")
    closes = prices.where(F.col("close") > 0).select(ID, F.col(DATE).alias("_bar"), F.col("close").alias("_close"))
    paid = as_of_join(cash, closes, ID, "ex_date", "_bar", strict=True).where(F.col("_close").isNotNull())
    factor = F.least(F.greatest(1 - F.col("value") / F.col("_close"), F.lit(1e-6)), F.lit(1.0))
    return _later(prices, paid.select(ID, "ex_date", factor.alias("factor")), "dividend_factor")


def adjusted_prices(prices: DataFrame, actions: DataFrame, dividends: bool = True) -> DataFrame:
    """Prices with split_factor, dividend_factor, cumulative_adjustment_factor and adjusted_close."""
    own = ["split_factor", "dividend_factor", "cumulative_adjustment_factor", "adjusted_close"]
    out = split_factors(prices.drop(*own), actions)
    out = dividend_factors(out, actions) if dividends else out.withColumn("dividend_factor", F.lit(1.0))
    out = out.withColumn("cumulative_adjustment_factor", F.col("split_factor") * F.col("dividend_factor"))
    return out.withColumn("adjusted_close", F.col("close") * F.col("cumulative_adjustment_factor"))
