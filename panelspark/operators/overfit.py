"""Overfitting statistics: moments, probabilistic and deflated Sharpe, PBO, block bootstrap, track record."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import normal_cdf, normal_quantile, normal_quantile_column
from panelspark.functions.windows import average_rank

GAMMA = 0.5772156649015329


def moments(returns: DataFrame, keys: Sequence[str] = ("strategy",), r: str = "net_return") -> DataFrame:
    """(keys, n, mean, sd, sharpe (per period), skew, kurtosis (plain)): sample deviation under population means of powers."""
    by = returns.where(F.col(r).isNotNull()).groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("_s"), F.kurtosis(r).alias("_k"))
    part = (F.col("n") - 1) / F.col("n")
    ok = F.col("sd") > 1e-12
    return by.select(*keys, "n", "mean", "sd", F.when(ok, F.col("mean") / F.col("sd")).alias("sharpe"), F.when(ok, F.col("_s") * F.pow(part, F.lit(1.5))).alias("skew"), F.when(ok, (F.col("_k") + 3) * part * part).alias("kurtosis"))


def _psr(sr, bench, n, skew, kurt):
    spread = F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))
    return F.when(n >= 2, normal_cdf((sr - bench) * F.sqrt(n - 1) / spread))


def probabilistic_sharpe(m: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """``psr``: the probability that the true per-period Sharpe ratio is over the benchmark."""
    return m.withColumn("psr", _psr(F.col("sharpe"), F.lit(benchmark), F.col("n"), F.col("skew"), F.col("kurtosis")))


def deflated_sharpe(m: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """``expected_max`` and ``dsr``: the probability to beat the best of as many skill-less trials; ``trials`` (sharpe) default to the series themselves."""
    t = (m if trials is None else trials).agg(F.count("sharpe").alias("_n"), F.stddev_samp("sharpe").alias("_sd"))
    bar = F.when(F.col("_n") >= 2, F.col("_sd") * ((1 - GAMMA) * normal_quantile_column(1 - 1 / F.col("_n")) + GAMMA * normal_quantile_column(1 - 1 / (F.col("_n") * math.e)))).otherwise(0.0)
    out = m.crossJoin(F.broadcast(t)).withColumn("expected_max", bar)  # one row
    return out.withColumn("dsr", _psr(F.col("sharpe"), F.col("expected_max"), F.col("n"), F.col("skew"), F.col("kurtosis"))).drop("_n", "_sd")


def minimum_track_record(m: DataFrame, benchmark: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """``min_periods`` until the PSR reaches the confidence; null where the Sharpe ratio is not over the benchmark."""
    z = normal_quantile(confidence)
    gap = F.col("sharpe") - benchmark
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    return m.withColumn("min_periods", F.when(gap > 0, 1 + spread * F.pow(F.lit(z) / gap, F.lit(2.0))))


def pbo(returns: DataFrame, blocks: int = 8, strategy: str = "strategy", t: str = "t", r: str = "net_return") -> DataFrame:
    """One row (n_splits, pbo): how often the best half-sample strategy ranks in the lower half of the other half.

    Sums by block make every balanced split a join with a small table of combinations
    (blocks choose half of them, whatever the data); null with fewer than two strategies or
    rows than two a block.
    """
    if blocks % 2:
        raise ValueError("the number of blocks must be even")
    spark = returns.sparkSession
    spans = returns.agg(F.min(t).alias("_a"), (F.max(t) - F.min(t) + 1).alias("_n"))
    rows = returns.crossJoin(F.broadcast(spans)).withColumn("block", F.least(F.floor((F.col(t) - F.col("_a")) * blocks / F.col("_n")), F.lit(blocks - 1)).cast("int"))
    by = rows.groupBy(strategy, "block").agg(F.count(r).alias("c"), F.sum(r).alias("s"), F.sum(F.col(r) * F.col(r)).alias("q"))
    table = [(i, b, b in chosen) for i, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    combos = spark.createDataFrame(table, "split int, block int, inside boolean")
    m = by.join(F.broadcast(combos), "block").groupBy("split", "inside", strategy).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("c")) / (F.col("c") - 1)
    m = m.withColumn("sr", F.when((F.col("c") > 1) & (var > 1e-20), F.col("s") / F.col("c") / F.sqrt(var)).otherwise(0.0))
    best = m.where("inside").groupBy("split").agg(F.max_by(strategy, F.struct("sr", F.col(strategy))).alias("_best"))
    out = m.where("NOT inside").withColumn("rank", average_rank(F.col("sr"), "split")).withColumn("_n", F.count("*").over(Window.partitionBy("split")))
    hit = out.join(F.broadcast(best), "split").where(F.col(strategy) == F.col("_best"))
    res = hit.agg(F.count("*").alias("n_splits"), F.avg((F.col("rank") / (F.col("_n") + 1) <= 0.5).cast("double")).alias("_p"))
    facts = returns.agg(F.count_distinct(strategy).alias("_k"), F.count_distinct(t).alias("_t"))
    return res.crossJoin(facts).select("n_splits", F.when((F.col("_k") >= 2) & (F.col("_t") >= 2 * blocks), F.col("_p")).alias("pbo"))


def bootstrap_sharpe(returns: DataFrame, replicates: int = 500, seed: int = 7, confidence: float = 0.95, r: str = "net_return", t: str = "t") -> DataFrame:
    """One row (n, block, low, high): moving blocks of about n^(1/3) periods, quantiles of the annualised Sharpe ratio."""
    spark = returns.sparkSession
    series = returns.where(F.col(r).isNotNull()).withColumn("i", F.row_number().over(Window.orderBy(t)) - 1).select("i", F.col(r).alias("_r"))  # one series
    n = series.count()
    if n < 2:
        return spark.createDataFrame([(n, None, None, None)], "n int, block int, low double, high double")
    block = max(1, round(n ** (1 / 3)))
    starts = spark.range(replicates).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))).alias("b"))
    starts = starts.withColumn("_s", F.floor(F.rand(seed) * (n - block + 1)))
    picks = starts.select("rep", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"), "b", "_s").where(F.col("b") * block + F.col("k") < n).select("rep", (F.col("_s") + F.col("k")).alias("i"))
    by = picks.join(F.broadcast(series), "i").groupBy("rep").agg(F.try_divide(F.avg("_r"), F.stddev_samp("_r")).alias("sr"))
    a = (1 - confidence) / 2
    return by.agg(F.percentile("sr", [a, 1 - a]).alias("_p")).select(F.lit(n).alias("n"), F.lit(block).alias("block"), (F.col("_p")[0] * math.sqrt(252)).alias("low"), (F.col("_p")[1] * math.sqrt(252)).alias("high"))


def halves(returns: DataFrame, keys: Sequence[str] = ("strategy",), r: str = "net_return", t: str = "as_of") -> DataFrame:
    """(keys, first_half_sharpe, second_half_sharpe), annualised."""
    w = Window.partitionBy(*keys).orderBy(t)
    df = returns.withColumn("_h", F.ntile(2).over(w))
    part = lambda h: F.try_divide(F.avg(F.when(F.col("_h") == h, F.col(r))), F.stddev_samp(F.when(F.col("_h") == h, F.col(r)))) * math.sqrt(252)
    return df.groupBy(*keys).agg(part(1).alias("first_half_sharpe"), part(2).alias("second_half_sharpe"))


def aligned(curves: DataFrame, keys: Sequence[str] = ("strategy",), t: str = "as_of") -> DataFrame:
    """Curves cut to the shortest one's length, with ``t`` numbered from 0."""
    df = curves.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(t)) - 1)
    short = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_m"))
    return df.crossJoin(F.broadcast(short)).where("_i < _m").withColumn("t", F.col("_i")).drop("_i", "_m")


def missing_trials(runs: DataFrame, trials: DataFrame) -> DataFrame:
    """Runs without a logged trial: statistics that count trials are optimistic for them."""
    return runs.join(trials.select("run_id").distinct(), "run_id", "left_anti").withColumn("flag", F.lit("optimistic"))
