"""Every strategy under every delay and cost scenario, in one job, and the stress table drawn from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID
from panelspark.operators.asof import as_of_join
from panelspark.operators.calendar import snapped
from panelspark.operators.costs import Costs, with_costs
from panelspark.operators.trades import liquidity

CELL = ["strategy", "delay", "cost_scenario"]


def _targets(weights: DataFrame) -> DataFrame:
    """(strategy, as_of, security_id, weight, previous): targets with those of the strategy's rebalance before."""
    dates = weights.select("strategy", "as_of").distinct()
    dates = dates.withColumn("_next", F.lead("as_of").over(Window.partitionBy("strategy").orderBy("as_of")))  # a row a rebalance
    was = weights.join(F.broadcast(dates), ["strategy", "as_of"]).where("_next IS NOT NULL")
    was = was.select("strategy", F.col("_next").alias("as_of"), ID, F.col("weight").alias("previous"))
    both = weights.select("strategy", "as_of", ID, "weight").join(was, ["strategy", "as_of", ID], "full_outer")
    return both.fillna(0.0, ["weight", "previous"])


def _fills(rows: DataFrame, cal: DataFrame, delays: Sequence[int]) -> DataFrame:
    """``rows`` once a delay, with the session that is so many after the signal; what falls off the calendar goes."""
    grid = rows.sparkSession.createDataFrame([(max(1, n),) for n in delays], "delay int")
    at = snapped(rows, cal, "as_of").crossJoin(F.broadcast(grid))  # a row a delay
    to = cal.select(F.col("session").alias("fill_date"), F.col("idx").alias("_to"))
    return at.join(F.broadcast(to), F.col("idx") + F.col("delay") == F.col("_to")).drop("idx", "_to")


def scenario_grid(weights: DataFrame, prices: DataFrame, cal: DataFrame, value: float, delays: Sequence[int] = (1,), costs: Costs = Costs(), scenarios: Mapping[str, float] | None = None, dust: float = 1.0) -> DataFrame:
    """One row a strategy, delay and cost scenario: n_rebalances, n_trades, cost_fraction (summed), worst_segment, log_growth.

    ``weights`` has (strategy, as_of, security_id, weight).  Delays and scenarios are short
    tables that are broadcast, so all cells share the joins with prices.  Between fills
    holdings are bought and held; each fill's costs, over ``value``, come off what is there.
    The last fill of a cell closes no segment.
    """
    moves = _fills(_targets(weights), cal, delays)
    bars = prices.select(ID, F.col(DATE).alias("_bar"), F.col("close").alias("reference_price"), F.col("adjusted_close").alias("_p"))
    moves = as_of_join(moves, bars, ID, "fill_date", "_bar").drop("_bar")
    trades = as_of_join(moves.where("reference_price > 0"), liquidity(prices).withColumnRenamed(DATE, "_state"), ID, "as_of", "_state")
    trades = trades.withColumn("shares", (F.col("weight") - F.col("previous")) * value / F.col("reference_price"))
    trades = trades.where(F.abs(F.col("shares") * F.col("reference_price")) >= dust)
    paid = with_costs(trades, costs, dict(scenarios) if scenarios else None).groupBy(*CELL, "fill_date").agg(F.count("*").alias("n"), (F.sum("total_cost") / value).alias("cost"))
    # what a holding is worth at the next fill of its strategy and delay
    fills = moves.select("strategy", "delay", "fill_date").distinct()
    fills = fills.withColumn("end_date", F.lead("fill_date").over(Window.partitionBy("strategy", "delay").orderBy("fill_date")))  # a row a rebalance
    held = moves.where("weight > 0").join(F.broadcast(fills), ["strategy", "delay", "fill_date"])
    later = prices.select(ID, F.col(DATE).alias("_bar"), F.col("adjusted_close").alias("_q"))
    held = as_of_join(held, later, ID, "end_date", "_bar")
    growth = F.coalesce(F.try_divide(F.col("_q"), F.col("_p")), F.lit(1.0))
    segments = held.where("end_date IS NOT NULL").groupBy("strategy", "delay", "fill_date").agg((F.sum(F.col("weight") * growth) + 1 - F.sum("weight")).alias("growth"))
    names = paid.select("cost_scenario").distinct()
    cells = fills.crossJoin(F.broadcast(names)).join(paid, [*CELL, "fill_date"], "left").join(segments, ["strategy", "delay", "fill_date"], "left")
    cost, up = F.coalesce("cost", F.lit(0.0)), F.coalesce("growth", F.lit(1.0))
    left = F.greatest(1 - cost, F.lit(1e-12))
    return cells.groupBy(*CELL).agg(
        F.count("*").alias("n_rebalances"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_trades"), F.sum(cost).alias("cost_fraction"),
        (F.min(up) - 1).alias("worst_segment"), F.sum(F.ln(up) + F.ln(left)).alias("log_growth"))


def stress_cases(grid: DataFrame, strategy: str, delay: int = 1, scenario: str = "base") -> DataFrame:
    """(case, ...): the grid's cells that differ from the base cell in one thing at most; the case names it."""
    other = {c: F.col(c) != F.lit(v) for c, v in zip(CELL, (strategy, delay, scenario), strict=True)}
    n_other = sum((o.cast("int") for o in other.values()), F.lit(0))
    case = F.when(other["strategy"], F.concat(F.lit("portfolio:"), "strategy")).when(other["delay"], F.concat(F.lit("delay:"), F.col("delay").cast("string")))
    case = case.when(other["cost_scenario"], F.concat(F.lit("cost:"), "cost_scenario")).otherwise("base")
    return grid.where(n_other <= 1).select(case.alias("case"), *grid.columns)
