"""Accounts marked day by day, and what their monitoring reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID
from panelspark.operators import metrics
from panelspark.operators.calendar import spanned
from panelspark.operators.labels import on_calendar
from panelspark.sources.shared import written


def _running(flows: DataFrame, keys: list[str], day: str, sums: list[str]) -> DataFrame:
    """Flows by key and day as levels that hold in [``day``, ``_until``)."""
    w = Window.partitionBy(*keys).orderBy(day)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return flows.withColumns({**{c: F.sum(c).over(upto) for c in sums}, "_until": F.lead(day).over(w)})


def equity_paths(fills: DataFrame, prices: DataFrame, cal: DataFrame, initial: float = 1_000_000.0) -> DataFrame:
    """(account, as_of, total_value, cash, positions_value, n_positions, n_unpriced, costs) on every session from an account's first fill on.

    Fills (account, security_id, ts, side, quantity, price, optional cost) count on their day, or the
    next session.  Each change of a position holds until the next one, and is copied to the sessions
    that it holds on; prices are carried to all sessions once a security, and both meet by equality, so
    no security's holders meet in one task.  A position without a price yet counts as nothing and in
    ``n_unpriced``.  Costs are running totals.
    """
    cost = F.coalesce(F.col("cost"), F.lit(0.0)) if "cost" in fills.columns else F.lit(0.0)
    q = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity")).cast("double")
    flows = fills.where("quantity IS NOT NULL AND price IS NOT NULL").select("account", ID, F.to_date("ts").alias("_on"), q.alias("_q"), (-q * F.col("price") - cost).alias("_cash"), cost.alias("_cost"))
    flows = written(flows.groupBy("account", ID, "_on").agg(*[F.sum(c).alias(c) for c in ("_q", "_cash", "_cost")]), "flows")
    held = _running(flows.select("account", ID, "_on", "_q"), ["account", ID], "_on", ["_q"]).where(F.abs("_q") > 1e-12)
    held = spanned(held, cal, "_on", "_until").select("account", ID, "as_of", "_q")
    days = cal.select(F.col("session").alias(DATE))
    marks = written(on_calendar(prices.select(ID, DATE, "close"), days, "close"), "marks").select(ID, F.col(DATE).alias("as_of"), "close")
    values = held.join(marks, [ID, "as_of"], "left").groupBy("account", "as_of").agg(
        F.sum(F.col("_q") * F.coalesce("close", F.lit(0.0))).alias("positions_value"), F.count("*").alias("n_positions"), F.count_if(F.col("close").isNull()).alias("n_unpriced"))
    daily = flows.groupBy("account", "_on").agg(F.sum("_cash").alias("_cash"), F.sum("_cost").alias("_cost"))
    cash = spanned(_running(daily, ["account"], "_on", ["_cash", "_cost"]), cal, "_on", "_until").select("account", "as_of", (F.col("_cash") + initial).alias("cash"), F.col("_cost").alias("costs"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("positions_value", "n_positions", "n_unpriced")}
    out = cash.join(values, ["account", "as_of"], "left").withColumns(zero)
    return out.select("account", "as_of", (F.col("cash") + F.col("positions_value")).alias("total_value"), "cash", F.col("positions_value").cast("double").alias("positions_value"), "n_positions", "n_unpriced", "costs")


def monitoring(equity: DataFrame, initial: float = 1_000_000.0, rebalances: DataFrame | None = None) -> DataFrame:
    """One row an account: its last marks, total return, Sharpe ratio, deepest fall and, with rebalances, expected and realised costs.

    ``rebalances`` is (account, expected_cost, realised_cost).  Statistics need three marks; the
    surprise is the mean over rebalances of what was paid beyond the expected cost, relative to it.
    """
    equity = written(equity, "equity")
    w = Window.partitionBy("account").orderBy("as_of")
    r = equity.withColumn("net_return", F.try_divide(F.col("total_value"), F.lag("total_value").over(w)) - 1)
    last = F.max_by(F.struct("total_value", "cash", "positions_value", "n_positions", "costs"), "as_of").alias("l")
    enough = lambda c: F.when(F.count("net_return") >= 2, c)
    by = r.groupBy("account").agg(last, F.max("as_of").alias("as_of"), F.min_by("total_value", "as_of").alias("_first"), F.count("net_return").alias("n_observations"), enough(metrics.sharpe(F.col("net_return"))).alias("sharpe"))
    falls = metrics.drawdowns(r.where("net_return IS NOT NULL"), ["account"])
    out = by.join(falls, "account", "left").select(
        "account", "as_of", "l.*", (F.col("l.total_value") / initial - 1).alias("total_return"), F.try_divide(F.col("l.total_value"), F.when(F.col("_first") > 0, F.col("_first"))).alias("_g"), "n_observations", "sharpe", F.when(F.col("n_observations") >= 2, F.col("max_drawdown")).alias("max_drawdown"))
    out = out.withColumn("return_since_first", F.col("_g") - 1).drop("_g")
    if rebalances is not None:
        surprise = F.when(F.col("expected_cost") > 1e-9, (F.col("realised_cost") - F.col("expected_cost")) / F.col("expected_cost"))
        c = rebalances.groupBy("account").agg(F.count("*").alias("n_rebalances"), F.sum("expected_cost").alias("expected_cost"), F.sum("realised_cost").alias("realised_cost"), F.avg(surprise).alias("cost_surprise"))
        out = out.join(c, "account", "left").withColumn("n_rebalances", F.coalesce("n_rebalances", F.lit(0)))
    return out
