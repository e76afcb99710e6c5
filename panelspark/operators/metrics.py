"""Performance statistics of return series, for any number of strategies and scenarios in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import average_rank

YEAR = 252.0


def cumulative(r: Column) -> Column:
    """Product of 1 + r, less one; -1 if any return is -100% or less."""
    return F.when(F.min(1 + r) <= 0, F.lit(-1.0)).otherwise(F.exp(F.sum(F.ln(1 + r))) - 1)


def cagr(r: Column) -> Column:
    total = cumulative(r)
    return F.when(total <= -1, F.lit(-1.0)).when(F.count(r) > 0, F.pow(1 + total, YEAR / F.count(r)) - 1)


def volatility(r: Column) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(YEAR))


def sharpe(r: Column) -> Column:
    return F.try_divide(F.avg(r), F.when(F.stddev_samp(r) > 1e-12, F.stddev_samp(r))) * F.sqrt(F.lit(YEAR))


def sortino(r: Column) -> Column:
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))))
    return F.try_divide(F.avg(r), F.when(down > 1e-12, down)) * F.sqrt(F.lit(YEAR))


def win_rate(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def profit_factor(r: Column) -> Column:
    """Gains over losses; null without losses."""
    return F.try_divide(F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r)))


def drawdowns(df: DataFrame, keys: Sequence[str], r: str = "net_return", day: str = "as_of") -> DataFrame:
    """(keys, max_drawdown): the deepest fall of the compounded series from its running peak, the start included."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    v = df.withColumn("_v", F.when(F.min(1 + F.col(r)).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(1 + F.col(r))).over(w))))
    v = v.withColumn("_p", F.greatest(F.max("_v").over(w), F.lit(1.0)))
    return v.groupBy(*keys).agg(F.min(F.col("_v") / F.col("_p") - 1).alias("max_drawdown"))


def value_at_risk(df: DataFrame, keys: Sequence[str], r: str = "net_return", q: float = 0.05) -> DataFrame:
    """(keys, var_95, expected_shortfall_95): linear quantile, and the mean of what is at or below it."""
    v = df.groupBy(*keys).agg(F.percentile(r, q).alias("var_95"))
    tail = df.join(F.broadcast(v), list(keys)).where(F.col(r) <= F.col("var_95"))  # a row a strategy
    return tail.groupBy(*keys).agg(F.first("var_95").alias("var_95"), F.avg(r).alias("expected_shortfall_95"))


def bundle(returns: DataFrame, keys: Sequence[str] = ("strategy", "cost_scenario"), r: str = "net_return", b: str | None = "benchmark_return", day: str = "as_of") -> DataFrame:
    """One row a series: twelve absolute metrics and, with a benchmark, six relative ones."""
    x = F.col(r)
    aggs = {"n": F.count(x), "cumulative_return": cumulative(x), "cagr": cagr(x), "volatility": volatility(x), "sharpe": sharpe(x), "sortino": sortino(x), "win_rate": win_rate(x), "profit_factor": profit_factor(x), "best": F.max(x), "worst": F.min(x)}
    if b is not None:
        y = F.col(b)
        act = x - y
        slope = F.regr_slope(x, y)
        aggs |= {
            "tracking_error": F.stddev_samp(act) * F.sqrt(F.lit(YEAR)), "information_ratio": F.try_divide(F.avg(act), F.when(F.stddev_samp(act) > 1e-12, F.stddev_samp(act))) * F.sqrt(F.lit(YEAR)),
            "beta": slope, "alpha": F.regr_intercept(x, y) * YEAR, "benchmark_cagr": cagr(y), "active_return": cagr(x) - cagr(y),
        }
    out = returns.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    out = out.join(drawdowns(returns, keys, r, day), list(keys)).join(value_at_risk(returns, keys, r), list(keys))
    return out.withColumn("calmar", F.try_divide(F.col("cagr"), -F.col("max_drawdown")))


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value)."""
    values = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(keys), values, "metric", "value")


def ic_by_date(df: DataFrame, score: str, realised: str, keys: Sequence[str] = (), day: str = "as_of", least: int = 3) -> DataFrame:
    """(keys, as_of, n, ic, pearson): Spearman (ties averaged) and Pearson correlation by date, over rows with both values."""
    by = [*keys, day]
    rows = df.where(F.col(score).isNotNull() & F.col(realised).isNotNull())
    rows = rows.withColumns({"_a": average_rank(F.col(score), *by), "_b": average_rank(F.col(realised), *by)})
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic"), F.corr(score, realised).alias("pearson"))
    return out.where(F.col("n") >= least)


def ic_summary(ic: DataFrame, keys: Sequence[str] = (), least_names: int = 5) -> DataFrame:
    """(keys, mean_ic, ic_std, ic_ir, share_positive, periods)."""
    rows = ic.where((F.col("n") >= least_names) & F.col("ic").isNotNull())
    out = rows.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("share_positive"), F.count("*").alias("periods"))
    return out.withColumn("ic_ir", F.try_divide(F.col("mean_ic"), F.when(F.col("ic_std") > 1e-12, F.col("ic_std"))))


def errors(df: DataFrame, predicted: str, realised: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mse, mae) over rows where both are finite."""
    e = F.col(predicted) - F.col(realised)
    return df.where(e.isNotNull() & ~F.isnan(e)).groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def performance_report(metrics: DataFrame, trades: DataFrame, provenance: str, keys: Sequence[str] = ("strategy", "cost_scenario")) -> DataFrame:
    """Metric rows with trade totals and whether the data are synthetic."""
    t = trades.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.sum("total_cost").alias("total_cost"), F.sum("notional").alias("traded"))
    return metrics.join(t, list(keys), "left").withColumns({"provenance": F.lit(provenance), "is_synthetic": F.lit(provenance != "real")})
