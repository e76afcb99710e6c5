"""Concentration, placebo and acceptance tests of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import ID

LIMITS = {"top5_securities": 0.5, "top_sector": 0.5, "top_year": 0.6, "best_days": 0.8}


def contributions(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(as_of, security_id, contribution) of weights and the returns they earned."""
    return weights.join(returns, ["as_of", ID]).select("as_of", ID, (F.col("weight") * F.col("raw_return")).alias("contribution"))


def concentration(contrib: DataFrame, sectors: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """One row: shares of the absolute result that the top 5 securities, the top sector and year, and the best 5% of days make; with warnings."""
    sec = F.coalesce("sector", F.lit("unknown"))
    df = contrib.join(sectors.select(ID, "sector"), ID, "left")

    def share(by: Column | str, k: int, name: str) -> DataFrame:
        g = df.groupBy(by).agg(F.abs(F.sum("contribution")).alias("c"))
        total = g.agg(F.sum("c").alias("_t"))
        return g.orderBy(F.col("c").desc()).limit(k).agg(F.sum("c").alias("_c")).crossJoin(total).select(F.try_divide("_c", "_t").alias(name))

    days = df.groupBy("as_of").agg(F.sum("contribution").alias("c"))
    n = Window.orderBy(F.col("c").desc(), "as_of")  # a row a date
    best = days.withColumn("_i", F.row_number().over(n)).crossJoin(days.agg(F.greatest(F.floor(F.count("*") * 0.05), F.lit(1)).alias("_k"), F.sum(F.abs("c")).alias("_t")))
    best = best.agg(F.try_divide(F.sum(F.when(F.col("_i") <= F.col("_k"), F.abs("c"))), F.max("_t")).alias("best_days"))
    out = share(ID, 5, "top5_securities").crossJoin(share(sec, 1, "top_sector")).crossJoin(share(F.year("as_of"), 1, "top_year")).crossJoin(best)
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(F.col(c) > v, F.lit(c)) for c, v in limits.items()])))


def shuffled(df: DataFrame, column: str, seed: int, day: str = "as_of") -> DataFrame:
    """The column's values dealt anew among the rows of each date."""
    w = Window.partitionBy(day)
    left = df.withColumn("_i", F.row_number().over(w.orderBy(ID)))
    right = df.select(day, F.col(column).alias("_v"), F.rand(seed).alias("_u")).withColumn("_i", F.row_number().over(w.orderBy("_u"))).drop("_u")
    return left.join(right, [day, "_i"]).withColumn(column, F.col("_v")).select(*df.columns)


def random_ranks(df: DataFrame, column: str, seed: int, day: str = "as_of") -> DataFrame:
    """The column replaced by a uniform rank / n by date."""
    w = Window.partitionBy(day)
    out = df.withColumn("_u", F.rand(seed))
    return out.withColumn(column, F.row_number().over(w.orderBy("_u", ID)) / F.count("*").over(w)).drop("_u")


def random_features(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.withColumns({f"noise_{i}": F.randn(seed + i) for i in range(n)})


def gates(metrics: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """(keys, gate, metric, value, threshold, passed) of long metrics against (gate, metric, direction, threshold); a missing value fails."""
    m = metrics.select(*keys, "metric", "value")
    every = m.select(*keys).distinct().crossJoin(F.broadcast(thresholds))  # a row a gate
    rows = every.join(m, [*keys, "metric"], "left")
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.select(*keys, "gate", "metric", "value", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def acceptance(gate_rows: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """(keys, n_failed, failed, status): accepted if every gate passes."""
    out = gate_rows.groupBy(*keys).agg(F.count_if(~F.col("passed")).alias("n_failed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed"))  # gates
    return out.withColumn("status", F.when(F.col("n_failed") == 0, "accepted").otherwise("rejected"))


def stress_table(cases: dict[str, DataFrame], keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """(case, keys..., metrics...): metric rows of several cases under one another; missing metrics are null."""
    out = None
    for name, df in cases.items():
        row = df.withColumn("case", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out.select("case", *keys, *[c for c in out.columns if c not in ("case", *keys)])


def worst_case(table: DataFrame, metric: str = "cagr", keys: Sequence[str] = ("strategy",)) -> DataFrame:
    return table.groupBy(*keys).agg(F.min(metric).alias(f"worst_{metric}"), F.min_by("case", metric).alias("worst_case"))
