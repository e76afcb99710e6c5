"""Preprocessing fitted on training rows only: bounds, medians and spreads as a table, applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clean, clip
from panelspark.functions.windows import average_rank

MAD = 1.4826


def fit(train: DataFrame, columns: Sequence[str], q: float = 0.01, approximate: bool = False) -> DataFrame:
    """(feature, lower, upper, median, scale) from the training rows; NaN counts as null.

    Scale is 1.4826 times the median absolute deviation, or the standard deviation where
    that is zero.  ``approximate`` uses bounded-memory quantiles for very large inputs.
    """
    long = train.select(*[clean(F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], list(columns), "feature", "x").where("x IS NOT NULL")
    points = [q, 0.5, 1 - q]
    agg = F.percentile_approx("x", points, 10_000) if approximate else F.percentile("x", points)
    first = long.groupBy("feature").agg(agg.alias("p"), F.stddev_samp("x").alias("sd"))
    middle = first.select("feature", F.col("p")[1].alias("_m"))
    gap = F.abs(F.col("x") - F.col("_m"))
    mad = long.join(F.broadcast(middle), "feature").groupBy("feature").agg((F.percentile_approx(gap, 0.5, 10_000) if approximate else F.percentile(gap, 0.5)).alias("_d"))
    return first.join(mad, "feature").select("feature", F.col("p")[0].alias("lower"), F.col("p")[2].alias("upper"), F.col("p")[1].alias("median"), F.when(F.col("_d") > 0, F.col("_d") * MAD).otherwise(F.col("sd")).alias("scale"))


def wide(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The stats as one row of structs named by feature."""
    return stats.groupBy().pivot("feature", list(columns)).agg(F.first(F.struct("lower", "upper", "median", "scale")))


def _with(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = wide(stats, columns).select(*[F.col(f"`{c}`").alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(one))  # one row


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": clean(F.col(c).cast("double")).isNull().cast("double") for c in columns})


def winsorize(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values held in the training bounds."""
    out = _with(df, stats, columns).withColumns({c: clip(F.col(c), F.col(f"_s_{c}.lower"), F.col(f"_s_{c}.upper")) for c in columns})
    return out.select(*df.columns)


def impute(df: DataFrame, stats: DataFrame, columns: Sequence[str], day: str = "as_of") -> DataFrame:
    """Null and NaN filled with the date's median, then with the training median."""
    w = Window.partitionBy(day)
    out = _with(df, stats, columns).withColumns({c: clean(F.col(c).cast("double")) for c in columns})
    out = out.withColumns({c: F.coalesce(F.col(c), F.median(c).over(w), F.col(f"_s_{c}.median")) for c in columns})
    return out.select(*df.columns)


def rank_normalize(df: DataFrame, columns: Sequence[str], day: str = "as_of") -> DataFrame:
    """(average rank - 0.5) / n - 0.5 by date."""
    w = Window.partitionBy(day)
    return df.withColumns({c: (average_rank(F.col(c), day) - 0.5) / F.count(c).over(w) - 0.5 for c in columns})


def robust_z(df: DataFrame, columns: Sequence[str], day: str = "as_of", bound: float = 5.0) -> DataFrame:
    """(x - median) / (1.4826 MAD) by date, clipped."""
    w = Window.partitionBy(day)
    out = df.withColumns({f"_m_{c}": F.median(c).over(w) for c in columns})
    out = out.withColumns({f"_d_{c}": F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).over(w) for c in columns})
    out = out.withColumns({c: clip((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_d_{c}") * MAD + 1e-12), -bound, bound) for c in columns})
    return out.select(*df.columns)


def drop_thin_dates(df: DataFrame, least: int, day: str = "as_of") -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(day))).where(F.col("_n") >= least).drop("_n")


def neutralize(df: DataFrame, columns: Sequence[str], group: str, day: str = "as_of") -> DataFrame:
    """Values less the mean of their date and group; rows without a group form one."""
    w = Window.partitionBy(day, group)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def apply(df: DataFrame, stats: DataFrame, columns: Sequence[str], how: str = "rank", day: str = "as_of", flags: bool = True, least_names: int = 1) -> DataFrame:
    """The whole chain: flags, winsorize, impute, then ``rank`` or ``robust_z``, then thin dates dropped."""
    out = missing_flags(df, columns) if flags else df
    out = impute(winsorize(out, stats, columns), stats, columns, day)
    out = {"rank": rank_normalize, "robust_z": robust_z}[how](out, columns, day)
    return drop_thin_dates(out, least_names, day)
