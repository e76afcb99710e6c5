"""Readers: files by extension, defaults of each table, and semi-structured text landed as files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.schemas import REQUIRED, require, schema

OPEN_END = "9999-12-31"


def read_any(spark: SparkSession, path: str, types: StructType | None = None) -> DataFrame:
    """Parquet, CSV/TXT with a header, or JSON lines, by extension; other extensions are refused."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "parquet":
        return spark.read.parquet(path)
    if end in ("csv", "txt"):
        # everything is text until the columns are coerced, so that bad values become null
        df = spark.read.csv(path, header=True)
        return coerce(df, types) if types else df
    if end in ("json", "jsonl"):
        return spark.read.schema(types).json(path) if types else spark.read.json(path)
    raise ValueError(f"no reader for .{end}")


def coerce(df: DataFrame, types: StructType) -> DataFrame:
    """Columns cast to the declared types where they are there; what does not parse is null."""
    known = {f.name: f.dataType for f in types}
    return df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])


def as_date(df: DataFrame, *columns: str) -> DataFrame:
    """Dates from dates, timestamps or text; bad values are null."""
    return df.withColumns({c: F.col(c).try_cast("timestamp").cast("date") for c in columns if c in df.columns})


def as_timestamp(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("timestamp") for c in columns if c in df.columns})


def between_dates(df: DataFrame, start: date | None, end: date | None, column: str = "observation_date") -> DataFrame:
    """Rows in [start, end]; reaches the scan as a pushed filter."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def only(df: DataFrame, ids: Sequence | DataFrame | None, column: str = "security_id") -> DataFrame:
    """Rows of the given ids: a list as a predicate, a frame of ids as a semi join, None for all."""
    if ids is None:
        return df
    return df.join(ids.select(column), column, "left_semi") if isinstance(ids, DataFrame) else df.where(F.col(column).isin(list(ids)))


def known_on(df: DataFrame, on, column: str = "available_at") -> DataFrame:
    """Rows published up to the end of the day ``on``."""
    return df.where(F.col(column) < F.date_add(F.lit(on) if isinstance(on, date) else on, 1).cast("timestamp"))


def _after(day: str, hours: int):
    return F.col(day).cast("timestamp") + F.make_interval(hours=F.lit(hours))


def _default(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in values.items()})


def prices(df: DataFrame) -> DataFrame:
    df = as_timestamp(as_date(require(df, *REQUIRED["prices"], what="prices"), "observation_date"), "available_at")
    df = _default(df, adjusted_close=F.col("close").cast("double"), volume=F.lit(None).cast("double"), available_at=_after("observation_date", 21))
    return _default(df, dollar_volume=F.col("close") * F.col("volume"))


def fundamentals(df: DataFrame, lag_days: int | None = None) -> DataFrame:
    """Availability as given, else from the filing (17:00 that day), else from an explicit lag after the period; a table that has none of these is refused.

    With a lag, rows whose filing date is missing get it too; without one they keep no availability and match nothing.
    """
    df = as_timestamp(as_date(require(df, *REQUIRED["fundamentals"], what="fundamentals"), "fiscal_period_end", "filing_date"), "available_at")
    if lag_days is None and not {"filing_date", "available_at"} & set(df.columns):
        raise ValueError("fundamentals have neither available_at nor filing_date, and no lag was given")
    if "filing_date" in df.columns:
        df = _default(df, available_at=_after("filing_date", 17))
    return df if lag_days is None else _default(df, available_at=F.date_add("fiscal_period_end", lag_days).cast("timestamp"))


def membership(df: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    df = as_date(require(df, *REQUIRED["membership"], "is_survivorship_biased", what="membership"), "start_date", "end_date")
    df = _default(df, end_date=F.lit(OPEN_END).cast("date"))
    if start is not None:
        df = df.where(F.col("end_date") >= F.lit(start))
    return df if end is None else df.where(F.col("start_date") <= F.lit(end))


def macro(df: DataFrame, lag_days: int = 30, series: Sequence[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    df = as_timestamp(as_date(require(df, *REQUIRED["macro"], what="macro"), "observation_date"), "available_at")
    late = F.date_add("observation_date", lag_days).cast("timestamp") + F.make_interval(hours=F.lit(8))
    df = _default(df, revision_id=F.lit(0).cast("long"), available_at=late)
    df = _default(df, is_revision=F.col("revision_id") > 0)
    return between_dates(df if series is None else df.where(F.col("series_id").isin(list(series))), start, end)


def corporate_actions(df: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    df = as_date(require(df, *REQUIRED["corporate_actions"], what="corporate actions"), "ex_date", "record_date", "payment_date")
    df = _default(df, value=F.lit(None).cast("double"), old_symbol=F.lit(None).cast("string"), new_symbol=F.lit(None).cast("string"), available_at=F.col("ex_date").cast("timestamp"))
    return between_dates(df, start, end, "ex_date")


def long_bars(wide: DataFrame, tickers: Sequence[str], field: str = "close", day: str = "observation_date") -> DataFrame:
    """A column a ticker to a row a ticker and day; null and non-positive values go."""
    out = wide.unpivot(day, list(tickers), "security_id", field)
    return out.where(F.col(field) > 0)


_OBSERVATIONS = "array<struct<date:string,value:string,realtime_start:string>>"
LAGS = {"Daily": 1, "Weekly": 7, "Monthly": 30, "Quarterly": 60}


def observations(spark: SparkSession, path: str, lags: Mapping[str, int] = LAGS) -> DataFrame:
    """JSON documents (series_id, units, frequency, observations) to vintages; '.' and empty values go."""
    df = spark.read.schema(f"series_id string, units string, frequency string, observations {_OBSERVATIONS}").json(path, multiLine=True)
    df = df.select("series_id", "units", "frequency", F.explode("observations").alias("o"))
    lag = F.coalesce(F.create_map(*[F.lit(x) for kv in lags.items() for x in kv])[F.col("frequency")], F.lit(30))
    day = F.to_date("o.date")
    known = F.coalesce(F.col("o.realtime_start").try_cast("timestamp"), F.date_add(day, lag).cast("timestamp"))
    df = df.select("series_id", day.alias("observation_date"), F.col("o.value").try_cast("double").alias("value"), "units", "frequency", known.alias("available_at")).where("value IS NOT NULL")
    w = Window.partitionBy("series_id", "observation_date").orderBy("available_at")
    return df.withColumn("revision_id", (F.row_number().over(w) - 1).cast("long")).withColumn("is_revision", F.col("revision_id") > 0)


_FACTS = "map<string,map<string,struct<units:map<string,array<struct<start:string,`end`:string,val:double,fp:string,form:string,filed:string>>>>>>"


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Company-facts JSON to (company, taxonomy, tag, unit, start, end, filed, value)."""
    df = spark.read.schema(f"cik long, entityName string, facts {_FACTS}").json(path, multiLine=True)
    df = df.select(F.col("cik").alias("company"), F.explode("facts").alias("taxonomy", "tags"))
    df = df.select("company", "taxonomy", F.explode("tags").alias("tag", "t"))
    df = df.select("company", "taxonomy", "tag", F.explode("t.units").alias("unit", "rows"))
    df = df.select("company", "taxonomy", "tag", "unit", F.explode("rows").alias("f"))
    return df.select("company", "taxonomy", "tag", "unit", F.to_date("f.start").alias("start"), F.to_date("f.end").alias("end"), F.to_date("f.filed").alias("filed"), F.col("f.val").alias("value"))


def facts_to_fundamentals(long: DataFrame, concepts: Mapping[str, str]) -> DataFrame:
    """One row for each (company, period end, filing) with a column a concept; ``concepts`` maps tags to columns."""
    name = F.create_map(*[F.lit(x) for kv in concepts.items() for x in kv])[F.col("tag")]
    df = long.withColumn("concept", name).where(F.col("concept").isNotNull())
    wide = df.groupBy(F.col("company").cast("string").alias("security_id"), F.col("end").alias("fiscal_period_end"), F.col("filed").alias("filing_date"))
    return fundamentals(wide.pivot("concept", sorted(set(concepts.values()))).agg(F.max_by("value", F.struct("start", "value"))))


def factor_text(spark: SparkSession, path: str, names: Sequence[str] = ("mkt_rf", "smb", "hml", "rf")) -> DataFrame:
    """Comma-separated text with lines of an 8-digit date and percentages; other lines go, percent becomes fraction."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    df = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d{8}\s*,")).select(parts.alias("p"))
    values = [(F.try_element_at("p", F.lit(i + 2)).try_cast("double") / 100).alias(n) for i, n in enumerate(names)]
    return df.select(F.to_date(F.col("p")[0], "yyyyMMdd").alias("observation_date"), *values)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
