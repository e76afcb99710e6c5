"""The panel's tables derived from the given order and event tables, in Spark and as SQL for the oracle.

Money is summed in whole cents, so that sums do not depend on the order of rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN = date(9999, 12, 31)
SPLIT_DAY = date(1998, 8, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return df.select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("observation_date"), "l_orderkey", "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"), F.round("l_quantity").cast("long").alias("q"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    unit = F.col("c") / (F.col("q") * 100.0)
    by = _lines(spark, d).groupBy("security_id", "observation_date").agg((F.sum("c") / (F.sum("q") * 100.0)).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("q").cast("double").alias("volume"), (F.sum("c") / 100.0).alias("dollar_volume"))
    return by.withColumn("adjusted_close", F.col("close"))


PRICES = """li AS (SELECT l_suppkey AS security_id, l_shipdate::DATE AS observation_date, l_orderkey, l_returnflag,
    round(l_extendedprice * 100)::BIGINT AS c, round(l_quantity)::BIGINT AS q FROM lineitem),
px AS (SELECT security_id, observation_date, sum(c)::DOUBLE / (sum(q)::DOUBLE * 100.0) AS close, max(c / (q * 100.0)) AS high, min(c / (q * 100.0)) AS low,
    sum(q)::DOUBLE AS volume, sum(c)::DOUBLE / 100.0 AS dollar_volume FROM li GROUP BY 1, 2)"""


def benchmark(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    """The price of all lines of a day; from ``bars``, whose sums in cents and units are whole numbers, it is the same."""
    if bars is not None:
        cents, units = F.sum(F.round(F.col("dollar_volume") * 100).cast("long")), F.sum(F.col("volume").cast("long"))
        return bars.groupBy("observation_date").agg((cents / (units * 100.0)).alias("close"))
    return _lines(spark, d).groupBy("observation_date").agg((F.sum("c") / (F.sum("q") * 100.0)).alias("close"))


BENCH = "bm AS (SELECT observation_date, sum(c)::DOUBLE / (sum(q)::DOUBLE * 100.0) AS close FROM li GROUP BY 1)"


def securities(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    """The security master; ``bars`` saves working the prices' spans out again."""
    region = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"))
    span = (_lines(spark, d) if bars is None else bars).groupBy("security_id").agg(F.min("observation_date").alias("first_trade_date"), F.max("observation_date").alias("_last"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"), "s_nationkey").join(F.broadcast(region), F.col("s_nationkey") == F.col("n_nationkey")).join(span, "security_id")
    dead = F.col("security_id") % 23 == 7
    return s.select("security_id", "sector", F.lit("common_stock").alias("security_type"), "first_trade_date", F.when(dead, F.date_sub("_last", 200)).alias("delisting_date"), F.when(dead, F.when(F.col("security_id") % 2 == 1, -1.0).otherwise(0.18)).alias("delisting_return"))


SECURITIES = """sec AS (SELECT s_suppkey AS security_id, r_name AS sector, f AS first_trade_date,
    CASE WHEN s_suppkey % 23 = 7 THEN l - 200 END AS delisting_date,
    CASE WHEN s_suppkey % 23 = 7 THEN CASE WHEN s_suppkey % 2 = 1 THEN -1.0 ELSE 0.18 END END::DOUBLE AS delisting_return
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT security_id, min(observation_date) AS f, max(observation_date) AS l FROM li GROUP BY 1) ON security_id = s_suppkey)"""


def corporate_actions(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"))
    splits = ids.where("security_id % 23 = 5").select("security_id", F.lit("stock_split").alias("action_type"), F.lit(SPLIT_DAY).alias("ex_date"), F.lit(2.0).alias("value"))
    days = F.explode(F.sequence(F.lit(date(1995, 3, 15)), F.lit(date(2001, 12, 15)), F.expr("interval 3 months")))
    cash = ids.where("security_id % 2 = 0").select("security_id", F.lit("cash_dividend").alias("action_type"), days.alias("ex_date"), F.lit(0.25).alias("value"))
    return splits.unionByName(cash)


ACTIONS = """ca AS (SELECT s_suppkey AS security_id, 'stock_split' AS action_type, DATE '1998-08-12' AS ex_date, 2.0::DOUBLE AS value FROM supplier WHERE s_suppkey % 23 = 5
  UNION ALL SELECT s_suppkey, 'cash_dividend', d::DATE, 0.25 FROM supplier, generate_series(DATE '1995-03-15', DATE '2001-12-15', INTERVAL 3 MONTH) t(d) WHERE s_suppkey % 2 = 0)"""


def membership(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    span = (_lines(spark, d) if bars is None else bars).groupBy("security_id").agg(F.min("observation_date").alias("f"))
    k = F.col("security_id")
    late = F.lit(date(1996, 6, 14))
    piece = lambda a, b: F.struct(a.alias("start_date"), b.alias("end_date"))
    end = F.lit(OPEN)
    spans = F.when(k % 31 == 13, F.array(piece(F.col("f"), F.lit(date(1997, 1, 1))), piece(F.lit(date(1998, 1, 1)), end))).when(k % 17 == 3, F.array(piece(late, end))).otherwise(F.array(piece(F.col("f"), end)))
    rows = span.select(k, F.explode(spans).alias("s")).select(k, F.lit("main").alias("universe"), "s.*")
    return rows.withColumns({"available_at": F.date_sub("start_date", 5).cast("timestamp"), "is_survivorship_biased": F.lit(False)})


MEMBERSHIP = """mf AS (SELECT security_id AS k, min(observation_date) AS f FROM li GROUP BY 1),
mem AS (SELECT k AS security_id, start_date, end_date, start_date - 5 AS available_at FROM (
    SELECT k, f AS start_date, DATE '1997-01-01' AS end_date FROM mf WHERE k % 31 = 13
    UNION ALL SELECT k, DATE '1998-01-01', DATE '9999-12-31' FROM mf WHERE k % 31 = 13
    UNION ALL SELECT k, DATE '1996-06-14', DATE '9999-12-31' FROM mf WHERE k % 31 <> 13 AND k % 17 = 3
    UNION ALL SELECT k, f, DATE '9999-12-31' FROM mf WHERE k % 31 <> 13 AND k % 17 <> 3))"""


def fundamentals(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("fiscal_period_end"))
    rows = _lines(spark, d).join(orders, "l_orderkey")
    back = F.when(F.col("l_returnflag") == "R", -F.col("c")).otherwise(F.col("c"))
    by = rows.groupBy("security_id", "fiscal_period_end").agg((F.sum("c") / 100.0).alias("revenue"), (F.sum(back) / 1000.0).alias("net_income"), (F.sum("q") * 1000.0 + 1e6).alias("total_assets"))
    filing = F.date_add("fiscal_period_end", (45 + F.col("security_id") % 31).cast("int"))
    return by.withColumns({"filing_date": filing, "available_at": filing.cast("timestamp") + F.expr("interval 17 hours")})


FUNDAMENTALS = """fu AS (SELECT *, filing_date::TIMESTAMP + INTERVAL 17 HOUR AS available_at FROM (SELECT security_id, pe AS fiscal_period_end, sum(c)::DOUBLE / 100.0 AS revenue,
    sum(CASE WHEN l_returnflag = 'R' THEN -c ELSE c END)::DOUBLE / 1000.0 AS net_income, sum(q)::DOUBLE * 1000.0 + 1e6 AS total_assets,
    (pe + (45 + security_id % 31)::INT) AS filing_date
  FROM li JOIN (SELECT o_orderkey, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE - 1 AS pe FROM orders) ON o_orderkey = l_orderkey GROUP BY security_id, pe))"""


def macro(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.last_day("o_orderdate").alias("observation_date"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    by = o.groupBy("observation_date").agg((F.sum(F.when(F.col("o_orderstatus") == "F", F.col("c"))) / 100.0).alias("v0"), (F.sum("c") / 100.0).alias("v1"))
    one = lambda r, v, lag: F.struct(F.lit(r).cast("long").alias("revision_id"), F.col(v).alias("value"), F.date_add("observation_date", lag).cast("timestamp").alias("available_at"))
    rows = by.select("observation_date", F.explode(F.array(one(0, "v0", 30), one(1, "v1", 90))).alias("r"))
    return rows.select(F.lit("ORDERS").alias("series_id"), "observation_date", "r.*").where("value IS NOT NULL")


MACRO = """mac AS (SELECT od AS observation_date, 0 AS revision_id, sum(c) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / 100.0 AS value, (od + 30)::TIMESTAMP AS available_at FROM mo GROUP BY od
  UNION ALL SELECT od, 1, sum(c)::DOUBLE / 100.0, (od + 90)::TIMESTAMP FROM mo GROUP BY od)"""
MACRO = "mo AS (SELECT last_day(o_orderdate) AS od, o_orderstatus, round(o_totalprice * 100)::BIGINT AS c FROM orders),\n" + MACRO


def fills(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("account"), (F.col("event_id") % 7).alias("security_id"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(1.0).alias("quantity"), F.round(F.col("value") * 100).cast("long").alias("cents"), (F.round(F.col("value") * 100) / 100).alias("price"))


FILLS = """fl AS (SELECT event_id, ts, user_id AS account, event_id % 7 AS security_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
    round(value * 100)::BIGINT AS cents FROM events WHERE event_type = 'purchase')"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Days on which anything traded, as a calendar (session, idx)."""
    days = _lines(spark, d).select(F.col("observation_date").alias("session")).distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("session")) - 1)


SESSIONS = "cal AS (SELECT observation_date AS session, row_number() OVER (ORDER BY observation_date) - 1 AS idx FROM (SELECT DISTINCT observation_date FROM li))"


def month_ends(spark: SparkSession, d: str) -> DataFrame:
    """(as_of): the last session of each month."""
    return sessions(spark, d).groupBy(F.trunc("session", "month")).agg(F.max("session").alias("as_of")).select("as_of")


MONTH_ENDS = "me AS (SELECT max(observation_date) AS as_of FROM li GROUP BY date_trunc('month', observation_date))"


def with_sql(*views: str) -> str:
    """WITH clause of the named views and what they need, in order."""
    return "WITH " + ",\n".join(dict.fromkeys([PRICES, *views]))
