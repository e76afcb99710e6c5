"""Security identity: rename intervals, symbol resolution on a date, lifecycle filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID
from panelspark.operators.asof import interval_join

OPEN = "9999-12-31"


def rename_intervals(actions: DataFrame, start: str = "1900-01-01") -> DataFrame:
    """symbol_change events to (security_id, symbol, start_date, end_date): half-open, the first from ``start``."""
    ev = actions.where((F.col("action_type") == "symbol_change") & F.col("new_symbol").isNotNull())
    w = Window.partitionBy(ID).orderBy("ex_date", "new_symbol")
    ev = ev.withColumns({"_next": F.lead("ex_date").over(w), "_n": F.row_number().over(w)})
    new = ev.select(ID, F.col("new_symbol").alias("symbol"), F.col("ex_date").alias("start_date"), F.coalesce("_next", F.lit(OPEN).cast("date")).alias("end_date"))
    old = ev.where((F.col("_n") == 1) & F.col("old_symbol").isNotNull()).select(ID, F.col("old_symbol").alias("symbol"), F.lit(start).cast("date").alias("start_date"), F.col("ex_date").alias("end_date"))
    return new.unionByName(old).where(F.col("start_date") < F.col("end_date"))


def resolve(requests: DataFrame, identifiers: DataFrame, symbol: str = "symbol", day: str = "as_of") -> DataFrame:
    """Each request (symbol, day) with the security that bore the symbol that day; primary listings first, then the smallest id."""
    i = identifiers.select(F.col("identifier_value").alias(symbol), ID, "start_date", "end_date", "is_primary")
    met = interval_join(requests, i, symbol, day, how="left")
    w = Window.partitionBy(*requests.columns).orderBy(F.col("is_primary").desc_nulls_last(), F.col(ID).asc_nulls_last())
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*requests.columns, ID)


def symbols_on(requests: DataFrame, identifiers: DataFrame, day: str = "as_of") -> DataFrame:
    """Each request (security_id, day) with its symbols that day."""
    i = identifiers.select(ID, F.col("identifier_value").alias("symbol"), "start_date", "end_date")
    return interval_join(requests, i, ID, day, how="left").drop("start_date", "end_date")


def renamed(identifiers: DataFrame) -> DataFrame:
    """Securities with more than one symbol over time."""
    return identifiers.groupBy(ID).agg(F.count_distinct("identifier_value").alias("n_symbols")).where("n_symbols > 1")


def listed_on(securities: DataFrame, day) -> DataFrame:
    """Securities trading on a day: first trade on or before it, not delisted by it."""
    d = F.lit(day).cast("date")
    return securities.where((F.col("first_trade_date").isNull() | (F.col("first_trade_date") <= d)) & (F.col("delisting_date").isNull() | (F.col("delisting_date") > d)))


def delisted(securities: DataFrame) -> DataFrame:
    return securities.where(F.col("delisting_date").isNotNull())


def of_type(securities: DataFrame, *types: str) -> DataFrame:
    return securities.where(F.col("security_type").isin(*types))


def master_from_prices(prices: DataFrame) -> DataFrame:
    """A security master where only bars are known: first date by id, the rest unknown."""
    none = F.lit(None)
    return prices.groupBy(ID).agg(F.min(DATE).alias("first_trade_date")).withColumns({"security_type": F.lit("common_stock"), "sector": none.cast("string"), "delisting_date": none.cast("date"), "delisting_return": none.cast("double")})
