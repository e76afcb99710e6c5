"""Factor evaluation: coverage, IC series, quantile returns, turnover, exposures, sub-periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clean
from panelspark.functions.windows import ID, average_rank
from panelspark.operators.metrics import ic_by_date, ic_summary


def melted(panel: DataFrame, factors: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(security_id, as_of, keep..., factor, x): one row a factor, so that all of them share one window."""
    df = panel.withColumns({f: clean(F.col(f).cast("double")) for f in factors})
    return df.select(ID, "as_of", *keep, *factors).unpivot([ID, "as_of", *keep], list(factors), "factor", "x")


def coverage(long: DataFrame) -> DataFrame:
    return long.groupBy("factor").agg((F.count("x") / F.count("*")).alias("coverage"))


def ic_series(long: DataFrame, realised: str, least: int = 5) -> DataFrame:
    """(factor, as_of, n, ic)."""
    return ic_by_date(long, "x", realised, ["factor"], least=least).select("factor", "as_of", "n", "ic")


def buckets(long: DataFrame, q: int = 5) -> DataFrame:
    """Rows with ``bucket`` 0..q-1: floor((rank - 1) * q / n) by factor and date, ties to the smaller id first."""
    rows = long.where("x IS NOT NULL")
    w = Window.partitionBy("factor", "as_of")
    rank = F.row_number().over(w.orderBy("x", ID))
    return rows.withColumn("bucket", F.floor((rank - 1) * q / F.count("*").over(w)).cast("int"))


def quantile_returns(long: DataFrame, realised: str, q: int = 5) -> DataFrame:
    """(factor, bucket, mean_return): mean over dates of each bucket's mean."""
    by = buckets(long.where(F.col(realised).isNotNull()), q).groupBy("factor", "as_of", "bucket").agg(F.avg(realised).alias("m"))
    return by.groupBy("factor", "bucket").agg(F.avg("m").alias("mean_return"))


def top_minus_bottom(quantiles: DataFrame, q: int = 5) -> DataFrame:
    return quantiles.groupBy("factor").agg((F.max(F.when(F.col("bucket") == q - 1, F.col("mean_return"))) - F.max(F.when(F.col("bucket") == 0, F.col("mean_return")))).alias("spread"))


def monotonicity(quantiles: DataFrame) -> DataFrame:
    """(factor, monotonicity): Spearman correlation of bucket and mean return."""
    r = quantiles.withColumn("_r", average_rank(F.col("mean_return"), "factor"))
    return r.groupBy("factor").agg(F.corr("bucket", "_r").alias("monotonicity"))


def factor_turnover(long: DataFrame, share: float = 0.2) -> DataFrame:
    """(factor, turnover): mean share of the top fifth that was not there on the date before."""
    rows = long.where("x IS NOT NULL")
    w = Window.partitionBy("factor", "as_of")
    top = rows.withColumns({"_k": F.greatest(F.floor(F.count("*").over(w) * share), F.lit(1)), "_n": F.row_number().over(w.orderBy(F.col("x").desc(), ID))}).where("_n <= _k").select("factor", "as_of", ID)
    dates = top.select("factor", "as_of").distinct().withColumn("_next", F.lead("as_of").over(Window.partitionBy("factor").orderBy("as_of")))
    was = top.join(dates, ["factor", "as_of"]).where("_next IS NOT NULL").select("factor", F.col("_next").alias("as_of"), ID, F.lit(1).alias("_old"))
    by = top.join(was, ["factor", "as_of", ID], "left").groupBy("factor", "as_of").agg((1 - F.count("_old") / F.count("*")).alias("_t"))
    first = dates.groupBy("factor").agg(F.min("as_of").alias("_first"))
    return by.join(first, "factor").where("as_of > _first").groupBy("factor").agg(F.avg("_t").alias("turnover"))


def exposures(panel: DataFrame, factors: Sequence[str], characteristics: Sequence[str], least: int = 5) -> DataFrame:
    """(factor, characteristic, exposure): mean by-date Spearman correlation."""
    a = melted(panel, factors)
    b = melted(panel, characteristics).select(ID, "as_of", F.col("factor").alias("characteristic"), F.col("x").alias("y"))
    ic = ic_by_date(a.join(b, [ID, "as_of"]), "x", "y", ["factor", "characteristic"], least=least)
    return ic.groupBy("factor", "characteristic").agg(F.avg("ic").alias("exposure"))


def by_year(ic: DataFrame) -> DataFrame:
    return ic.groupBy("factor", F.year("as_of").alias("year")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("periods"))


def factor_report(panel: DataFrame, factors: Sequence[str], realised: str, q: int = 5, least: int = 5) -> DataFrame:
    """One row a factor, best IC IR first, undefined last."""
    long = melted(panel, factors, [realised])
    quantiles = quantile_returns(long, realised, q)
    out = coverage(long)
    for part in (ic_summary(ic_series(long, realised, least), ["factor"], least), top_minus_bottom(quantiles, q), monotonicity(quantiles), factor_turnover(long)):
        out = out.join(part, "factor", "left")
    return out.orderBy(F.col("ic_ir").desc_nulls_last(), "factor")
