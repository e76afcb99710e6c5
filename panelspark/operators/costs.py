"""Trading costs as columns: commission, half spread, slippage and impact, in any cost scenario."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCENARIOS = {"zero": 0.0, "base": 1.0, "double": 2.0, "triple": 3.0}
UNKNOWN_ADV_SHARE = 0.05


@dataclass(frozen=True)
class Costs:
    commission: str = "bps"  # per_share, per_order, bps, zero
    commission_rate: float = 0.5
    least_commission: float = 0.0
    spread: str = "liquidity"  # fixed, liquidity
    spread_bps: float = 2.0
    slippage: str = "fixed"  # fixed, volatility, participation
    slippage_bps: float = 1.0
    impact: float = 0.1
    impact_power: float = 0.5


def commission(c: Costs, shares: Column, notional: Column) -> Column:
    raw = {"per_share": F.abs(shares) * c.commission_rate, "per_order": F.lit(c.commission_rate), "bps": notional * c.commission_rate / 1e4, "zero": F.lit(0.0)}[c.commission]
    return F.when(notional > 0, raw if c.commission == "zero" else F.greatest(raw, F.lit(c.least_commission))).otherwise(0.0)


def half_spread(c: Costs, notional: Column, adv: Column) -> Column:
    """Fixed, or widened by sqrt(1e7 / ADV) held in [0.5, 10]; 3 where the ADV is unknown."""
    wide = F.when(adv > 0, F.least(F.greatest(F.sqrt(1e7 / adv), F.lit(0.5)), F.lit(10.0))).otherwise(3.0)
    return notional * c.spread_bps / 1e4 * (wide if c.spread == "liquidity" else F.lit(1.0))


def participation(notional: Column, adv: Column) -> Column:
    return F.when(adv > 0, notional / adv).otherwise(UNKNOWN_ADV_SHARE)


def slippage(c: Costs, notional: Column, adv: Column, volatility: Column) -> Column:
    """Fixed; by daily volatility over 1%; or by participation over 1%."""
    daily = F.coalesce(volatility, F.lit(0.3)) / F.sqrt(F.lit(252.0))
    scale = {"fixed": F.lit(1.0), "volatility": daily / 0.01, "participation": participation(notional, adv) / 0.01}[c.slippage]
    return notional * c.slippage_bps / 1e4 * scale


def impact(c: Costs, notional: Column, adv: Column, volatility: Column) -> Column:
    daily = F.coalesce(volatility, F.lit(0.3)) / F.sqrt(F.lit(252.0))
    return c.impact * daily * F.pow(participation(notional, adv), F.lit(c.impact_power)) * notional


def with_costs(trades: DataFrame, c: Costs = Costs(), scenarios: dict[str, float] | None = None) -> DataFrame:
    """Each trade (shares, reference_price, adv, volatility) in each scenario: notional, four costs, total_cost, cost_bps, effective_price.

    Buys pay more and sells get less than the reference price by the cost of a share.
    """
    spark = trades.sparkSession
    s = spark.createDataFrame(list((scenarios or SCENARIOS).items()), "cost_scenario string, _x double")
    n, adv, vol = F.col("notional"), F.col("adv"), F.col("volatility")
    df = trades.withColumn("notional", F.abs(F.col("shares") * F.col("reference_price"))).crossJoin(F.broadcast(s))  # a row a scenario
    df = df.withColumns({"commission": commission(c, F.col("shares"), n) * F.col("_x"), "spread_cost": half_spread(c, n, adv) * F.col("_x"), "slippage_cost": slippage(c, n, adv, vol) * F.col("_x"), "impact_cost": impact(c, n, adv, vol) * F.col("_x")})
    total = F.col("commission") + F.col("spread_cost") + F.col("slippage_cost") + F.col("impact_cost")
    per_share = F.coalesce(F.try_divide(F.col("total_cost"), F.abs("shares")), F.lit(0.0))
    df = df.withColumn("total_cost", total)
    return df.withColumns({"cost_bps": F.try_divide(F.col("total_cost") * 1e4, n), "effective_price": F.col("reference_price") + F.signum("shares") * per_share}).drop("_x")
