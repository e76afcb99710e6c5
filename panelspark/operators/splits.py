"""Walk-forward splits with purge and embargo, a holdout, and the checks that guard them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTH, YEAR = 30, 365.25


@dataclass(frozen=True)
class Schedule:
    """Lengths in days: months are 30 and years 365.25 days."""

    train_years: float = 3.0
    validation_months: float = 6.0
    test_months: float = 6.0
    step_months: float = 6.0


def folds(spark: SparkSession, start: date, end: date, s: Schedule = Schedule()) -> DataFrame:
    """Expanding training windows: (fold, train_start, train_end, validation_start, validation_end, test_start, test_end), ends exclusive.

    A last fold is kept if more than half of its test window lies before ``end``.
    """
    days = lambda n: timedelta(days=round(n))
    rows, i = [], 0
    while True:
        v0 = start + days(s.train_years * YEAR) + days(i * s.step_months * MONTH)
        t0 = v0 + days(s.validation_months * MONTH)
        t1 = t0 + days(s.test_months * MONTH)
        if t1 > end:
            if (end - t0).days * 2 > (t1 - t0).days:
                rows.append((i, start, v0, v0, t0, t0, end))
            break
        rows.append((i, start, v0, v0, t0, t0, t1))
        i += 1
    return spark.createDataFrame(rows, "fold int, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date")


def usable_end(cal: DataFrame, holdout_start: date) -> DataFrame:
    """The last session before the holdout."""
    return cal.where(F.col("session") < F.lit(holdout_start)).agg(F.max("session").alias("usable_end"))


def with_embargo(schedule: DataFrame, cal: DataFrame | None = None, embargo: int = 0) -> DataFrame:
    """The schedule with ``_last``: training rows stay before it, ``embargo`` sessions ahead of the validation start."""
    f = schedule.withColumn("_last", F.col("validation_start"))
    if cal is not None and embargo:
        back = cal.select("session", F.lag("session", embargo).over(Window.orderBy("session")).alias("_e"))
        f = f.join(back.where("_e IS NOT NULL"), F.col("session") >= F.col("validation_start")).groupBy(*schedule.columns).agg(F.min_by("_e", "session").alias("_last"))
    return f


def split_panel(panel: DataFrame, schedule: DataFrame, cal: DataFrame | None = None, embargo: int = 0, purge: bool = True, day: str = "as_of") -> DataFrame:
    """The panel with fold and split (train, validation, test), in one pass over all folds.

    Training rows within ``embargo`` sessions of the validation start go; with ``purge`` so
    do training rows whose label window reaches it, and validation rows whose window
    reaches the test start.
    """
    f = with_embargo(schedule, cal, embargo)
    at, until = F.col(day), F.col("window_end")
    inside = lambda a, b: (at >= F.col(a)) & (at < F.col(b))
    reach = lambda c: (until.isNull() | (until < F.col(c))) if purge else F.lit(True)
    split = F.when(inside("train_start", "train_end") & (at < F.col("_last")) & reach("validation_start"), "train").when(inside("validation_start", "validation_end") & reach("test_start"), "validation").when(inside("test_start", "test_end"), "test")
    out = panel.join(F.broadcast(f), (at >= F.col("train_start")) & (at < F.col("test_end")))  # a row a fold
    return out.withColumn("split", split).where("split IS NOT NULL").select(*panel.columns, "fold", "split")


def single_split(panel: DataFrame, test_start: date, cal: DataFrame, embargo: int = 0, purge: bool = True, day: str = "as_of") -> DataFrame:
    """The panel with split (train, test) around one date."""
    last = cal.where(F.col("session") >= F.lit(test_start)).agg(F.min("idx").alias("i"))
    edge = cal.join(last, F.col("idx") == F.col("i") - embargo).select(F.col("session").alias("_edge"))
    rows = panel.join(F.broadcast(edge), how="cross")  # one row
    train = (F.col(day) < F.col("_edge")) & (F.col(day) < F.lit(test_start))
    if purge:
        train &= F.col("window_end").isNull() | (F.col("window_end") < F.lit(test_start))
    return rows.withColumn("split", F.when(F.col(day) >= F.lit(test_start), "test").when(train, "train")).where("split IS NOT NULL").drop("_edge")


def holdout_rows(panel: DataFrame, start: date, allowed: bool = False, acknowledged: bool = False, day: str = "as_of") -> DataFrame:
    """The rows from ``start`` on; both flags are needed."""
    if not (allowed and acknowledged):
        raise PermissionError("the holdout is closed: it needs a flag and an acknowledgement")
    return panel.where(F.col(day) >= F.lit(start))


def assert_untouched(panel: DataFrame, start: date, day: str = "as_of") -> None:
    """Raises if a research panel holds rows, or label windows, of the holdout."""
    until = F.col("window_end") if "window_end" in panel.columns else F.col(day)
    if panel.where((F.col(day) >= F.lit(start)) | (until >= F.lit(start))).limit(1).count():
        raise ValueError("the panel reaches into the holdout")


def fold_report(split: DataFrame, schedule: DataFrame, day: str = "as_of") -> DataFrame:
    """(fold, split, n, first, last, ok): whether each part lies inside its bounds and no training window reaches the validation."""
    by = split.groupBy("fold", "split").agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.max("window_end").alias("_until"))
    out = by.join(F.broadcast(schedule), "fold")
    lo = F.when(F.col("split") == "train", F.col("train_start")).when(F.col("split") == "validation", F.col("validation_start")).otherwise(F.col("test_start"))
    hi = F.when(F.col("split") == "train", F.col("train_end")).when(F.col("split") == "validation", F.col("validation_end")).otherwise(F.col("test_end"))
    safe = (F.col("split") != "train") | F.col("_until").isNull() | (F.col("_until") < F.col("validation_start"))
    return out.select("fold", "split", "n", "first", "last", ((F.col("first") >= lo) & (F.col("last") < hi) & safe).alias("ok"))


def assert_safe(split: DataFrame, schedule: DataFrame, day: str = "as_of") -> None:
    """Raises if a fold lacks a part or breaks its bounds."""
    report = fold_report(split, schedule, day).select("fold", "split", "ok").collect()  # three rows a fold
    missing = {r["fold"] for r in schedule.select("fold").collect()} - {f for f in {r["fold"] for r in report} if sum(r["fold"] == f for r in report) == 3}
    if missing or not all(r["ok"] for r in report):
        raise ValueError(f"unsafe folds: {sorted(missing | {r['fold'] for r in report if not r['ok']})}")


def last_signal_date(cal: DataFrame, end: date, horizon: int, delay: int = 1) -> DataFrame:
    """The last session whose whole label window lies in the data."""
    last = cal.where(F.col("session") <= F.lit(end)).agg(F.max("idx").alias("i"))
    return cal.join(F.broadcast(last), F.col("idx") == F.col("i") - horizon - delay).select(F.col("session").alias("last_signal_date"))


def score_holdout_once(scores: DataFrame, results_path: str, run_id: str) -> DataFrame:
    """Appends one holdout evaluation for a run; a second one is refused."""
    spark = scores.sparkSession
    try:
        done = spark.read.parquet(results_path).where(F.col("run_id") == run_id).limit(1).count()
    except Exception as e:  # the first evaluation of all
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = 0
    if done:
        raise ValueError(f"the holdout of run {run_id} is scored already")
    scores.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(results_path)
    return spark.read.parquet(results_path).where(F.col("run_id") == run_id)
