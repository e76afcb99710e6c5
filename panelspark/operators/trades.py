"""From target weights to trades, holdings and an equity curve, as joins and windows over rebalances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID, rolling
from panelspark.operators.asof import as_of_join
from panelspark.operators.calendar import numbered, shifted, spanned
from panelspark.operators.costs import Costs, with_costs
from panelspark.operators.weights import with_previous


def liquidity(prices: DataFrame) -> DataFrame:
    """(security_id, observation_date, adv, volatility): 21 rows (5) of dollar volume, 60 rows (20) of simple returns."""
    r = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy(ID).orderBy(DATE))) - 1
    df = prices.withColumn("_r", r)
    return df.select(ID, DATE, rolling(F.avg, F.col("dollar_volume"), 21, 5).alias("adv"), (rolling(F.stddev_samp, F.col("_r"), 60, 20) * F.sqrt(F.lit(252.0))).alias("volatility"))


def fill_dates(weights: DataFrame, cal: DataFrame, delay: int = 1) -> DataFrame:
    """``fill_date``: at least one session after the signal; null off the end of the calendar."""
    return shifted(weights, cal, "as_of", max(1, delay), "fill_date")


def trade_list(weights: DataFrame, prices: DataFrame, cal: DataFrame, value: float, delay: int = 1, dust: float = 1.0, costs: Costs = Costs(), scenarios: dict[str, float] | None = None) -> DataFrame:
    """Trades between consecutive target weights at fill prices: sells first, then by notional; trades under ``dust`` go.

    Shares are for a fixed portfolio value (no compounding between rebalances).
    """
    moves = fill_dates(with_previous(weights), cal, delay).where(F.col("fill_date").isNotNull())
    bars = prices.select(ID, F.col(DATE).alias("price_date"), F.col("close").alias("reference_price"))
    moves = as_of_join(moves, bars, ID, "fill_date", "price_date").where(F.col("reference_price") > 0)
    state = liquidity(prices).withColumnRenamed(DATE, "_state_date")
    moves = as_of_join(moves, state, ID, "as_of", "_state_date").drop("_state_date")
    moves = moves.withColumn("shares", (F.col("weight") - F.col("previous")) * value / F.col("reference_price"))
    moves = moves.where(F.abs(F.col("shares") * F.col("reference_price")) >= dust)
    out = with_costs(moves, costs, scenarios)
    order = Window.partitionBy("cost_scenario", "fill_date").orderBy(F.when(F.col("shares") < 0, 0).otherwise(1), F.col("notional").desc(), ID)
    out = out.withColumns({"side": F.when(F.col("shares") < 0, "sell").otherwise("buy"), "sequence": F.row_number().over(order), "information_date": F.col("as_of"), "signal_date": F.col("as_of"), "order_date": F.col("fill_date"), "accounting_date": F.col("fill_date")})
    return out.drop("weight", "previous", "price_date")


def holdings(weights: DataFrame, cal: DataFrame, delay: int = 1) -> DataFrame:
    """(security_id, weight, start_date, end_date): targets in force from their fill to the next one."""
    filled = fill_dates(weights, cal, delay).where(F.col("fill_date").isNotNull())
    fills = filled.select("fill_date").distinct().withColumn("end_date", F.lead("fill_date").over(Window.orderBy("fill_date")))  # a row a rebalance
    return filled.join(F.broadcast(fills), "fill_date").select(ID, "weight", F.col("fill_date").alias("start_date"), "end_date")


def equity_curve(weights: DataFrame, prices: DataFrame, cal: DataFrame, delay: int = 1, trade_costs: DataFrame | None = None, start_value: float = 1.0) -> DataFrame:
    """(as_of, segment_start, segment_growth, cost_fraction, value): buy and hold between rebalances, chained.

    Within a segment value grows by sum(w * p / p at fill) plus the cash weight; at each
    fill ``trade_costs`` (fill_date, cost_fraction: costs over the value at the previous
    rebalance) is taken off; costs of the whole value leave nothing.  Prices are carried forward over sessions without a bar.
    """
    held = holdings(weights, cal, delay)
    live = spanned(held, cal, "start_date", "end_date", closed=True)
    bars = prices.select(ID, F.col(DATE).alias("_bar"), F.col("adjusted_close").alias("_p"))
    live = as_of_join(live, bars, ID, "as_of", "_bar").drop("_bar")
    live = live.withColumn("_p0", F.first("_p", ignorenulls=True).over(Window.partitionBy(ID, "start_date").orderBy("as_of")))
    growth = F.coalesce(F.try_divide(F.col("_p"), F.col("_p0")), F.lit(1.0))
    seg = live.groupBy("start_date", "end_date", "as_of").agg((F.sum(F.col("weight") * growth) + 1 - F.sum("weight")).alias("segment_growth"))
    costs = trade_costs if trade_costs is not None else weights.sparkSession.createDataFrame([], "fill_date date, cost_fraction double")
    seg = seg.join(F.broadcast(costs.withColumnRenamed("fill_date", "start_date")), "start_date", "left").withColumn("cost_fraction", F.coalesce("cost_fraction", F.lit(0.0)))
    # a session that ends a segment belongs to the next one, but its growth closes the old one
    ends = seg.where("as_of = end_date").select(F.col("end_date").alias("start_date"), F.ln("segment_growth").alias("_g"))
    starts = seg.select("start_date", "cost_fraction").distinct().join(ends, "start_date", "left")
    chain = Window.orderBy("start_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a rebalance
    starts = starts.select("start_date", F.exp(F.sum(F.coalesce("_g", F.lit(0.0)) + F.ln(F.greatest(1 - F.col("cost_fraction"), F.lit(1e-12)))).over(chain)).alias("_base"))
    out = seg.where("end_date IS NULL OR as_of < end_date").join(F.broadcast(starts), "start_date")
    return out.select("as_of", F.col("start_date").alias("segment_start"), "segment_growth", "cost_fraction", (start_value * F.col("_base") * F.col("segment_growth")).alias("value"))


def curve_returns(curve: DataFrame) -> DataFrame:
    """(as_of, value, net_return) from one session to the next."""
    w = Window.orderBy("as_of")  # a row a session
    return curve.select("as_of", "value", (F.try_divide(F.col("value"), F.lag("value").over(w)) - 1).alias("net_return"))


def marks(held_shares: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """(as_of, positions_value): shares held in [start_date, end_date) at the last price known on each day."""
    cal = numbered(days.select(F.col("as_of").alias("session")).distinct())
    live = spanned(held_shares, cal, "start_date", "end_date")
    bars = prices.select(ID, F.col(DATE).alias("_bar"), F.col("close").alias("_p"))
    return as_of_join(live, bars, ID, "as_of", "_bar").groupBy("as_of").agg(F.sum(F.col("shares") * F.col("_p")).alias("positions_value"))


def dividend_cash(held_shares: DataFrame, actions: DataFrame) -> DataFrame:
    """(security_id, ex_date, cash) of dividends on shares held on the ex-date."""
    cash = actions.where((F.col("action_type") == "cash_dividend") & (F.col("value") > 0)).select(F.col(ID).alias("_k"), "ex_date", "value")
    hit = (F.col(ID) == F.col("_k")) & (F.col("start_date") < F.col("ex_date")) & (F.col("end_date").isNull() | (F.col("ex_date") <= F.col("end_date")))
    return held_shares.join(cash, hit).select(ID, "ex_date", (F.col("shares") * F.col("value")).alias("cash"))


def delisting_proceeds(held_shares: DataFrame, securities: DataFrame, prices: DataFrame) -> DataFrame:
    """(security_id, delisting_date, proceeds): last price times 1 + delisting return (null is -100%, 0.0 is 0.0) of shares held."""
    dead = securities.where("delisting_date IS NOT NULL").select(F.col(ID).alias("_k"), "delisting_date", F.coalesce("delisting_return", F.lit(-1.0)).alias("_r"))
    hit = (F.col(ID) == F.col("_k")) & (F.col("start_date") <= F.col("delisting_date")) & (F.col("end_date").isNull() | (F.col("delisting_date") < F.col("end_date")))
    rows = held_shares.join(dead, hit).drop("_k")
    bars = prices.select(ID, F.col(DATE).alias("_bar"), F.col("close").alias("_p"))
    return as_of_join(rows, bars, ID, "delisting_date", "_bar").select(ID, "delisting_date", (F.col("shares") * F.col("_p") * (1 + F.col("_r"))).alias("proceeds"))
