"""Peer scorecard: percentiles, family scores and a composite for all names of a date in one job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID
from panelspark.operators.factors import melted

# Factors of each family, 1 where high is good and -1 where low is.
FAMILIES: Mapping[str, Mapping[str, int]] = {
    "momentum": {"momentum_12m_ex1m": 1, "momentum_126d": 1, "dist_52w_high": 1},
    "trend": {"trend_slope_63d": 1, "ma_distance_50d": 1},
    "risk": {"volatility_60d": -1, "downside_vol_60d": -1, "max_drawdown_252d": 1, "beta_252d": -1},
    "liquidity": {"adv_21d": 1, "amihud_illiquidity_21d": -1},
    "value": {"earnings_yield": 1, "book_to_market": 1},
    "quality": {"return_on_equity": 1, "operating_margin": 1},
}
LABELS = ((80.0, "very strong"), (60.0, "strong"), (40.0, "average"), (20.0, "weak"))


def scored(panel: DataFrame, families: Mapping[str, Mapping[str, int]] = FAMILIES) -> DataFrame:
    """(security_id, as_of, family, factor, x, percentile, peer_median): the share of peers strictly below, turned where low is good."""
    table = [(f, fam, s) for fam, fs in families.items() for f, s in fs.items() if f in panel.columns]
    spark = panel.sparkSession
    kinds = spark.createDataFrame(table, "factor string, family string, sign int")
    long = melted(panel, [t[0] for t in table]).where("x IS NOT NULL").join(F.broadcast(kinds), "factor")
    w = Window.partitionBy("as_of", "factor")
    n = F.count("*").over(w)
    p = (F.rank().over(w.orderBy("x")) - 1) / n * 100
    return long.select(ID, "as_of", "family", "factor", "x", F.when(F.col("sign") > 0, p).otherwise(100 - p).alias("percentile"), F.median("x").over(w).alias("peer_median"), "sign")


def family_scores(s: DataFrame) -> DataFrame:
    """(security_id, as_of, family, score, label)."""
    by = s.groupBy(ID, "as_of", "family").agg(F.avg("percentile").alias("score"), F.count("*").alias("n_factors"))
    label = F.lit("very weak")
    for least, name in reversed(LABELS):
        label = F.when(F.col("score") >= least, name).otherwise(label)
    return by.withColumn("label", label)


def composite(s: DataFrame) -> DataFrame:
    """(security_id, as_of, composite, rank): the mean of family means of ordinal ranks in [0, 1]; ties to the smaller id."""
    w = Window.partitionBy("as_of", "factor")
    turned = s.withColumn("_v", F.col("x") * F.col("sign"))
    r = turned.withColumn("_r", F.coalesce(F.try_divide(F.row_number().over(w.orderBy("_v", F.col(ID).desc())) - 1, F.count("*").over(w) - 1), F.lit(0.5)))
    fam = r.groupBy(ID, "as_of", "family").agg(F.avg("_r").alias("_f"))
    out = fam.groupBy(ID, "as_of").agg(F.avg("_f").alias("composite"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("composite").desc(), ID)))


def latest_date(panel: DataFrame, needed: str = "momentum_126d", least_peers: int = 20) -> DataFrame:
    """One row (as_of, peers): the last date on which enough peers have the factor."""
    by = panel.where(F.col(needed).isNotNull()).groupBy("as_of").agg(F.count("*").alias("peers")).where(F.col("peers") >= least_peers)
    return by.agg(F.max_by(F.struct("as_of", "peers"), "as_of").alias("_x")).select("_x.*")


def compared(scores: DataFrame, ids: list, families: Mapping[str, Mapping[str, int]] = FAMILIES) -> DataFrame:
    """A row a security with a column a family, best mean first, undefined last."""
    wide = scores.where(F.col(ID).isin(ids)).groupBy(ID, "as_of").pivot("family", list(families)).agg(F.first("score"))
    total = F.array_compact(F.array(*list(families)))
    mean = F.when(F.size(total) > 0, F.aggregate(total, F.lit(0.0), lambda a, x: a + x) / F.size(total))
    return wide.withColumn("mean_score", mean).orderBy(F.col("mean_score").desc_nulls_last(), ID)


def provisional_bars(history: DataFrame, quotes: DataFrame) -> DataFrame:
    """History plus a bar of each newer quote, its volume null, ``is_provisional``; quotes that are not newer change nothing."""
    last = history.groupBy(ID).agg(F.max(DATE).alias("_last"))
    q = quotes.groupBy("ticker", "session_date").agg(F.max_by("price", "fetched_at").alias("price")).withColumnRenamed("ticker", ID)
    q = q.where("price > 0").join(last, ID).where(F.col("session_date") > F.col("_last"))
    new = q.select(ID, F.col("session_date").alias(DATE), F.col("price").alias("close"), F.col("price").alias("adjusted_close"), F.lit(True).alias("is_provisional"))
    return history.withColumn("is_provisional", F.lit(False)).unionByName(new, allowMissingColumns=True)


def with_market_cap(panel: DataFrame, prices: DataFrame, shares: DataFrame) -> DataFrame:
    """``market_cap``: last close times filed shares, by security."""
    last = prices.groupBy(ID).agg(F.max_by("close", DATE).alias("_close"))
    cap = last.join(shares.select(ID, "shares_outstanding"), ID).select(ID, (F.col("_close") * F.col("shares_outstanding")).alias("market_cap"))
    return panel.join(cap, ID, "left")


def split_benchmark(bars: DataFrame, ticker: str) -> tuple[DataFrame, DataFrame]:
    """(bars without the benchmark, the benchmark's with simple benchmark_return, null first)."""
    w = Window.partitionBy(ID).orderBy(DATE)
    b = bars.where(F.col(ID) == ticker).withColumn("benchmark_return", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    return bars.where(F.col(ID) != ticker), b


def without_data(requested: DataFrame, bars: DataFrame) -> DataFrame:
    return requested.join(bars.select(ID).distinct(), ID, "left_anti")
