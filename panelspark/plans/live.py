"""Queries that run as streams over the event table, and queries over written results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import metrics, results, scorecard
from panelspark.plans import views as V
from panelspark.plans.features import rounded
from panelspark.plans.research import _RET, _SCORE, _FAM, _returns, feature_panel
from panelspark.sources.shared import folder, written
from panelspark.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of its files."""
    at = f"{d}/events.parquet"
    # a pattern, since a stream takes a folder or a pattern and the table may be one file
    return spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _fills(events: DataFrame) -> DataFrame:
    e = events.where("event_type = 'purchase'")
    return e.select("event_id", "ts", F.col("user_id").alias("account"), (F.col("event_id") % 7).alias("security_id"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(1.0).alias("quantity"), (F.round(F.col("value") * 100) / 100).alias("price"))


def _ran(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], at: str) -> None:
    """Runs a stream over all that is there, and ends."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def _latest(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """The last row of each key that a stream gave out; a batch that is retried replaces its own rows."""
    spark = stream.sparkSession
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    _ran(stream, mode, sink, at)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/rows")
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


@query("WITH " + V.FILLS + """ SELECT account, security_id, sum(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END)::DOUBLE AS quantity, round(sum(CASE WHEN side = 'buy' THEN -cents ELSE cents END) / 100.0, 2) AS cash FROM fl GROUP BY 1, 2""")
def stream_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions and cash of a stream of fills."""
    p = _latest(streams.positions(_fills(_events(spark, d))), "update", ["account", "security_id"])
    return p.select("account", "security_id", "quantity", F.round("cash", 2).alias("cash"))


@query("""WITH q AS (SELECT event_id % 5 AS ticker, ts::DATE AS day, ts AS t, value FROM events), m AS (SELECT max(t) - INTERVAL 1 HOUR AS w FROM q)
SELECT ticker, day AS session_date, arg_max(value, t) AS close FROM q, m WHERE day + INTERVAL 1 DAY <= w GROUP BY 1, 2""")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of each day that the watermark has passed."""
    quotes = _events(spark, d).select((F.col("event_id") % 5).alias("ticker"), "ts", F.col("value").alias("price"))
    return _latest(streams.provisional_bars(quotes), "append", ["ticker", "session_date"])


@query("""WITH l AS (SELECT event_id, event_id % 50 AS order_id, ts AS t, CASE WHEN event_type IN ('view', 'click') THEN 'approve' ELSE 'reject' END AS decision FROM events)
SELECT order_id, arg_max(decision, (t, event_id)) AS decision, max(t) AS at FROM l GROUP BY 1""")
def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The latest decision of each order from a log that brings every event twice."""
    e = _events(spark, d)
    log = e.select("event_id", (F.col("event_id") % 50).alias("order_id"), F.col("ts").alias("at"), F.when(F.col("event_type").isin("view", "click"), "approve").otherwise("reject").alias("decision"))
    twice = log.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
    out = _latest(streams.decisions(twice), "update", ["order_id"])
    return out.select("order_id", "decision", F.col("at").cast("timestamp_ntz").alias("at"))


@query("""WITH b AS (SELECT user_id, ts::DATE AS d, value - 1 AS close, CASE WHEN event_id % 41 = 0 THEN 1 ELSE 2 END AS high FROM events)
SELECT 'invalid_price' AS "check", count(*) AS n FROM b WHERE close <= 0 UNION ALL SELECT 'invalid_ohlc', count(*) FROM b WHERE high < 1.5""")
def stream_quality(spark: SparkSession, d: str) -> DataFrame:
    """Findings among arriving bars, counted batch by batch."""
    bars = _events(spark, d).select(F.col("user_id").alias("security_id"), F.to_date("ts").alias("observation_date"), (F.col("value") - 1).alias("close"), F.when(F.col("event_id") % 41 == 0, 1.0).otherwise(2.0).alias("high"), F.lit(1.5).alias("low"))
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    _ran(bars, "append", streams.quality_counts(f"{at}/findings"), at)
    return spark.read.parquet(f"{at}/findings").groupBy("check").agg(F.sum("n").alias("n")).where("n > 0")


def _store(spark: SparkSession, d: str) -> str:
    """A results folder with equity, results and weights of every name as a strategy of two runs."""
    root = f"{folder(spark)}/results-{uuid.uuid4().hex}"
    r = written(_returns(spark, d), "returns")
    run = F.when(F.pmod("strategy", F.lit(2)) == 0, "even").otherwise("odd").alias("run_id")
    base = [run, F.lit("none").alias("model"), F.col("strategy").cast("string").alias("strategy"), F.lit("base").alias("cost_scenario")]
    w = Window.partitionBy("strategy").orderBy("as_of")
    value = F.exp(F.sum(F.ln(1 + F.col("net_return"))).over(w))
    results.append(r.select(*base, "as_of", value.alias("value"), "net_return"), root, "strategy_equity")
    m = metrics.long_metrics(metrics.bundle(r, ["strategy"]).select("strategy", "sharpe", "volatility", "win_rate"), ["strategy"])
    results.append(m.select(*base, "metric", "value"), root, "strategy_result")
    return root


_RUNS = _RET + """, eq AS (SELECT CASE WHEN strategy % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id, strategy::VARCHAR AS strategy, as_of, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY as_of)) AS value FROM ret),
fl AS (SELECT *, value / max(value) OVER (PARTITION BY strategy ORDER BY as_of) - 1 AS f FROM eq),
mt AS (SELECT CASE WHEN strategy % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id, strategy::VARCHAR AS strategy, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, stddev_samp(r) * sqrt(252) AS volatility, avg((r > 0)::INT::DOUBLE) AS win_rate FROM ret GROUP BY strategy)"""


@query(_RUNS + """ SELECT run_id, NULL::VARCHAR AS strategy, 'count' AS section, 'strategy_equity' AS metric, count(*)::DOUBLE AS value FROM eq GROUP BY 1
UNION ALL SELECT run_id, NULL, 'count', 'strategy_result', count(*) * 3.0 FROM mt GROUP BY 1
UNION ALL SELECT run_id, strategy, 'equity', unnest(['first_day', 'last_day', 'last_value', 'max_drawdown']), round(unnest([min(as_of) - DATE '1970-01-01', max(as_of) - DATE '1970-01-01', arg_max(value, as_of), min(f)]), 6) FROM fl GROUP BY 1, 2
UNION ALL SELECT run_id, strategy, 'strategy', unnest(['sharpe', 'volatility', 'win_rate']), round(unnest([sharpe, volatility, win_rate]), 6) FROM mt""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of two written runs."""
    return rounded(results.run_report(spark, _store(spark, d)).select("run_id", "strategy", "section", "metric", "value"))


@query(_RUNS + " SELECT strategy, as_of, round(value, 6) AS value FROM eq WHERE run_id = 'odd' AND as_of >= DATE '1999-01-01' ORDER BY strategy, as_of LIMIT 50 OFFSET 25")
def purpose_equity(spark: SparkSession, d: str) -> DataFrame:
    """A page of one run's equity from a date on."""
    from datetime import date

    page, _ = results.ask(spark, _store(spark, d), "equity", "odd", 50, 25, start=date(1999, 1, 1))
    return rounded(page.select("strategy", "as_of", "value"))


@query(_RUNS + " SELECT strategy, round(sharpe, 6) AS sharpe, round(volatility, 6) AS volatility FROM mt WHERE run_id = 'even'")
def strategy_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A row a strategy of one run with a column a metric."""
    long = results.read(spark, _store(spark, d), "strategy_result", run_id="even")
    return rounded(results.comparison(long, ["strategy"], ["sharpe", "volatility"]))


@query(_RUNS + " SELECT run_id, max(sharpe) >= 1 AS good, round(max(sharpe), 6) AS best FROM mt GROUP BY 1")
def select_over_results(spark: SparkSession, d: str) -> DataFrame:
    """A user's SELECT over the written tables."""
    sql = "WITH b AS (SELECT run_id, max(value) AS best FROM strategy_result WHERE metric = 'sharpe' GROUP BY run_id) SELECT run_id, best >= 1 AS good, round(best, 6) AS best FROM b"
    return results.select_only(spark, _store(spark, d), sql)


@query(_SCORE + """, p AS (SELECT *, (rank() OVER (PARTITION BY as_of, family ORDER BY x) - 1) / count(*) OVER (PARTITION BY as_of, family)::DOUBLE * 100 AS p FROM sg),
f AS (SELECT security_id, as_of, family, CASE WHEN sign = 1 THEN p ELSE 100 - p END AS s FROM p), ld AS (SELECT max(as_of) AS as_of FROM (SELECT as_of FROM fx WHERE momentum_21d IS NOT NULL GROUP BY 1 HAVING count(*) >= 8)),
w AS (SELECT security_id, f.as_of, any_value(s) FILTER (WHERE family = 'momentum') AS momentum, any_value(s) FILTER (WHERE family = 'risk') AS risk, any_value(s) FILTER (WHERE family = 'liquidity') AS liquidity, avg(s) AS m FROM f JOIN ld USING (as_of) WHERE security_id IN (1, 2, 3, 4, 5, 6) GROUP BY 1, 2)
SELECT security_id, as_of, round(momentum, 6) AS momentum, round(risk, 6) AS risk, round(liquidity, 6) AS liquidity, round(m, 6) AS mean_score FROM w""")
def peers_compared(spark: SparkSession, d: str) -> DataFrame:
    """Six names side by side by family on the newest date with enough peers."""
    f = written(feature_panel(spark, d), "features")
    scores = scorecard.family_scores(scorecard.scored(f, _FAM))
    day = scorecard.latest_date(f, "momentum_21d", 8).select("as_of")
    out = scorecard.compared(scores.join(F.broadcast(day), "as_of", "left_semi"), [1, 2, 3, 4, 5, 6], _FAM)  # one date
    return rounded(out)


@query(V.with_sql() + """ SELECT n_name AS name, round(r, 6) AS benchmark_return, as_of FROM (SELECT n_nationkey, n_name FROM nation) LEFT JOIN (SELECT security_id, observation_date AS as_of, close / lag(close) OVER (ORDER BY observation_date) - 1 AS r FROM px WHERE security_id = 3) ON security_id = n_nationkey WHERE n_nationkey = 3
UNION ALL SELECT n_name, NULL, NULL FROM nation WHERE n_nationkey NOT IN (SELECT security_id FROM px)""")
def benchmark_split(spark: SparkSession, d: str) -> DataFrame:
    """One name's bars as a benchmark with its simple returns, and the requested names that have no bars."""
    p = written(V.prices(spark, d), "prices")
    asked = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("security_id"), F.col("n_name").alias("name"))
    _, b = scorecard.split_benchmark(p, 3)
    have = b.join(asked, "security_id").select("name", F.round("benchmark_return", 6).alias("benchmark_return"), F.col("observation_date").alias("as_of"))
    none = scorecard.without_data(asked, p).select("name", F.lit(None).cast("double").alias("benchmark_return"), F.lit(None).cast("date").alias("as_of"))
    return have.unionByName(none)
