"""Queries over checks with planted faults, calendars, splits, books and run logs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import calendar, checks, ledger, models, preprocess, results, risk, splits, trades, universe
from panelspark.plans import views as V
from panelspark.plans.features import _W, rounded
from panelspark.plans.research import _FEAT, _UNIVERSE, FACTORS, _ar, feature_panel
from panelspark.plans.states import _LABELS, _SCREENS, _labels
from panelspark.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = datetime(2001, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Bars with faults: a factor that falls every June, availability before the bar, after ``NOW``, and blank identifiers."""
    p = V.prices(spark, d)
    factor = F.when(F.month("observation_date") == 6, 0.5).otherwise(1.0)
    early = (F.pmod("security_id", F.lit(10)) == 3) & (F.dayofmonth("observation_date") == 1)
    known = F.date_add("observation_date", F.when(early, -2).otherwise(1)).cast("timestamp")
    blank = F.when(F.pmod("security_id", F.lit(37)) == 5, F.lit(" ")).otherwise(F.col("security_id").cast("string"))
    return p.withColumns({"cumulative_adjustment_factor": factor, "available_at": known, "label": blank})


_AT = "security_id || '@' || observation_date"
_FOUND = V.with_sql(V.BENCH, V.SESSIONS, V.ACTIONS, V.MEMBERSHIP) + f""",
pl AS (SELECT *, CASE WHEN month(observation_date) = 6 THEN 0.5 ELSE 1.0 END AS f, observation_date + CASE WHEN security_id % 10 = 3 AND day(observation_date) = 1 THEN -2 ELSE 1 END AS known,
    CASE WHEN security_id % 37 = 5 THEN ' ' ELSE security_id::VARCHAR END AS label FROM px),
fs AS (SELECT 'non_monotonic_adjustment' AS "check", 'warning' AS severity, count(*) AS n, min({_AT}) AS first FROM (SELECT *, lag(f) OVER ({_W}) - f AS s FROM pl) WHERE s > 1e-9
UNION ALL SELECT 'impossible_availability', 'critical', count(*), min({_AT}) FROM pl WHERE known < observation_date
UNION ALL SELECT 'future_dated', 'critical', count(*), min({_AT}) FROM pl WHERE known > DATE '2001-01-01'
UNION ALL SELECT 'missing_identifier', 'critical', count(*), min(label) FROM pl WHERE trim(label) = ''
UNION ALL SELECT 'benchmark_gaps', CASE WHEN count(*) FILTER (WHERE day(session) = 13) > 0.01 * count(*) THEN 'critical' ELSE 'warning' END, count(*) FILTER (WHERE day(session) = 13), min(session) FILTER (WHERE day(session) = 13)::VARCHAR
  FROM cal WHERE session BETWEEN (SELECT min(observation_date) FROM bm WHERE day(observation_date) <> 13) AND (SELECT max(observation_date) FROM bm WHERE day(observation_date) <> 13)
UNION ALL SELECT 'invalid_corporate_action', 'critical', count(*), min(security_id || '@' || ex_date) FROM ca WHERE security_id % 8 = 2 AND month(ex_date) = 3
UNION ALL SELECT 'invalid_symbol_change', 'critical', count(*), min(s_suppkey || '@1999-01-04') FROM supplier WHERE s_suppkey % 9 = 4
UNION ALL SELECT 'calendar_mismatch', 'warning', count(*), min({_AT}) FROM px WHERE dayofweek(observation_date) = 3 AND observation_date BETWEEN (SELECT min(session) FROM cal WHERE dayofweek(session) <> 3) AND (SELECT max(session) FROM cal WHERE dayofweek(session) <> 3)
UNION ALL SELECT 'membership_overlap', 'critical', count(*), min(security_id || '@' || start_date) FROM (SELECT *, lead(start_date) OVER (PARTITION BY security_id ORDER BY start_date, end_date) AS nx FROM
  (SELECT security_id, start_date, CASE WHEN end_date < DATE '9999-01-01' THEN end_date + 400 ELSE end_date END AS end_date FROM mem)) WHERE nx < end_date
UNION ALL SELECT 'invalid_price', 'critical', count(*), min({_AT}) FROM px WHERE security_id % 19 = 2 AND day(observation_date) = 7
UNION ALL SELECT 'invalid_ohlc', 'critical', count(*), min({_AT}) FROM px WHERE security_id % 19 = 3 AND day(observation_date) = 8
UNION ALL SELECT 'invalid_volume', 'critical', count(*), min({_AT}) FROM px WHERE security_id % 19 = 4 AND day(observation_date) = 9)
SELECT * FROM fs WHERE n > 0"""


@query(_FOUND)
def planted_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every check on data with planted faults, with the first example of each."""
    p = written(_planted(spark, d), "planted")
    cal = written(V.sessions(spark, d), "sessions")
    k, day = F.col("security_id"), F.dayofmonth("observation_date")
    spoilt = p.withColumns({
        "close": F.when((F.pmod(k, F.lit(19)) == 2) & (day == 7), -1.0).otherwise(F.col("close")),
        "high": F.when((F.pmod(k, F.lit(19)) == 3) & (day == 8), F.col("low") - 1).otherwise(F.col("high")),
        "volume": F.when((F.pmod(k, F.lit(19)) == 4) & (day == 9), -1.0).otherwise(F.col("volume")),
    })
    bench = V.benchmark(spark, d).where(day != 13)
    acts = V.corporate_actions(spark, d).where("action_type = 'cash_dividend' OR security_id IS NOT NULL")
    bad = (F.pmod(k, F.lit(8)) == 2) & (F.month("ex_date") == 3)
    acts = acts.withColumns({"value": F.when(bad, 0.0).otherwise(F.col("value")), "new_symbol": F.lit(None).cast("string")})
    change = V.table(spark, d, "supplier").where("s_suppkey % 9 = 4").select(F.col("s_suppkey").alias("security_id"), F.lit("symbol_change").alias("action_type"), F.lit(date(1999, 1, 4)).alias("ex_date"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("new_symbol"))
    mem = V.membership(spark, d).withColumn("end_date", F.when(F.col("end_date") < F.lit(date(9999, 1, 1)), F.date_add("end_date", 400)).otherwise(F.col("end_date")))
    parts = [
        checks.adjustment_order(p), checks.availability(p, NOW, "prices"), checks.missing_identifier(p, "prices", "label"), checks.benchmark_gaps(bench, cal),
        checks.action_payload(acts.unionByName(change)), checks.calendar_mismatch(p, cal.where(F.dayofweek("session") != 4)), checks.membership_overlap(mem), checks.price_values(spoilt),
    ]
    out = checks.report(*parts)
    return out.select("check", "severity", "n", F.try_element_at("examples", F.lit(1)).alias("first"))


@query(V.with_sql(V.SESSIONS) + """, dd AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, (SELECT min(session) FROM cal WHERE session >= day) AS next_session, (SELECT max(session) FROM cal WHERE idx = (SELECT min(idx) FROM cal WHERE session >= day) - 1) AS previous_session FROM dd""")
def session_navigation(spark: SparkSession, d: str) -> DataFrame:
    """For each order day the session on or after it and the one before that."""
    cal = written(V.sessions(spark, d), "sessions")
    days = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return calendar.shifted(calendar.shifted(days, cal, "day", 0, "next_session"), cal, "day", -1, "previous_session")


@query(V.with_sql(V.SESSIONS) + """ SELECT (SELECT count(*) FROM cal WHERE session BETWEEN DATE '1996-02-01' AND DATE '1998-03-31') AS n, (SELECT max(session) FROM cal WHERE session < DATE '2000-01-01') AS usable_end,
 (SELECT session FROM cal WHERE idx = (SELECT max(idx) FROM cal WHERE session <= DATE '2000-06-30') - 22) AS last_signal_date""")
def schedule_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Sessions between two days, the last one before a holdout, and the last signal whose label window is whole."""
    cal = written(V.sessions(spark, d), "sessions")
    n = calendar.count_between(cal, date(1996, 2, 1), date(1998, 3, 31))
    return n.crossJoin(splits.usable_end(cal, date(2000, 1, 1))).crossJoin(splits.last_signal_date(cal, date(2000, 6, 30), 21, 1))  # one row each


@query(_LABELS + f""", {V.SESSIONS}, {V.MONTH_ENDS}, z AS (SELECT * FROM l2 WHERE as_of IN (SELECT as_of FROM me)),
ed AS (SELECT session AS edge FROM cal WHERE idx = (SELECT min(idx) FROM cal WHERE session >= DATE '1999-01-04') - 5),
y AS (SELECT CASE WHEN as_of >= DATE '1999-01-04' THEN 'test' WHEN as_of < edge AND as_of < DATE '1999-01-04' AND window_end < DATE '1999-01-04' THEN 'train' END AS split, as_of FROM z, ed)
SELECT split, count(*) AS n, min(as_of) AS first, max(as_of) AS last FROM y WHERE split IS NOT NULL GROUP BY 1""")
def single_split(spark: SparkSession, d: str) -> DataFrame:
    """Training and test rows around one date, with purge and an embargo of five sessions."""
    s = splits.single_split(_labels(spark, d), date(1999, 1, 4), written(V.sessions(spark, d), "sessions"), 5)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))


@query(_UNIVERSE + """, tn AS (SELECT as_of, security_id, adv, row_number() OVER (PARTITION BY as_of ORDER BY adv DESC, security_id) AS i FROM ex WHERE rule IS NULL)
SELECT as_of, security_id, round(adv, 2) AS adv FROM tn WHERE i <= 5""")
def universe_top_n(spark: SparkSession, d: str) -> DataFrame:
    """The five most traded eligible names of each month end."""
    from dataclasses import replace

    s = replace(_SCREENS, top_n=5)
    u = universe.universe_panel(V.month_ends(spark, d), V.membership(spark, d), V.securities(spark, d), V.prices(spark, d), s)
    return u.select("as_of", "security_id", F.round("adv", 2).alias("adv"))


@query(_UNIVERSE + " SELECT median(n) AS median_size, median(n) >= 40 AS selective FROM (SELECT as_of, count(*) AS n FROM ex WHERE rule IS NULL GROUP BY 1)")
def universe_selectivity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the median universe leaves a choice of twenty holdings."""
    u = universe.universe_panel(V.month_ends(spark, d), V.membership(spark, d), V.securities(spark, d), V.prices(spark, d), _SCREENS)
    return universe.selectivity(u, 20)


@query(_FEAT + """ SELECT as_of, count(*) AS n, sum((momentum_21d IS NULL)::INT)::DOUBLE AS momentum_missing, sum((volatility_20d IS NULL)::INT)::DOUBLE AS volatility_missing FROM fx
WHERE as_of IN (SELECT as_of FROM fx GROUP BY 1 HAVING count(*) >= 8) GROUP BY 1""")
def missing_by_date(spark: SparkSession, d: str) -> DataFrame:
    """How many names lack a feature on each date that has enough of them."""
    f = preprocess.missing_flags(preprocess.drop_thin_dates(feature_panel(spark, d), 8), ["momentum_21d", "volatility_20d"])
    return f.groupBy("as_of").agg(F.count("*").alias("n"), F.sum("momentum_21d_was_missing").alias("momentum_missing"), F.sum("volatility_20d_was_missing").alias("volatility_missing"))


_HELD = "hs AS (SELECT s_suppkey AS security_id, DATE '1996-03-01' + (s_suppkey % 40)::INT AS start_date, DATE '1999-09-01' + (s_suppkey % 25)::INT AS end_date, (10 + s_suppkey % 5)::DOUBLE AS shares FROM supplier)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    day = lambda a, n: F.date_add(F.lit(a), F.pmod(k, F.lit(n)).cast("int"))
    return V.table(spark, d, "supplier").select(k.alias("security_id"), day(date(1996, 3, 1), 40).alias("start_date"), day(date(1999, 9, 1), 25).alias("end_date"), (F.pmod(k, F.lit(5)) + 10).cast("double").alias("shares"))


@query(V.with_sql(V.SESSIONS) + f""", {_HELD}, lv AS (SELECT hs.security_id, session AS as_of, shares FROM hs JOIN cal ON session >= start_date AND session < end_date)
SELECT lv.as_of, round(sum(shares * close), 4) AS positions_value FROM lv ASOF LEFT JOIN px ON px.security_id = lv.security_id AND px.observation_date <= lv.as_of GROUP BY 1""")
def position_marks(spark: SparkSession, d: str) -> DataFrame:
    """Shares of every name held over its own span, marked at the last price on each session."""
    days = V.sessions(spark, d).select(F.col("session").alias("as_of"))
    return rounded(trades.marks(_held(spark, d), V.prices(spark, d), days), 4)


@query(V.with_sql(V.ACTIONS) + f", {_HELD} SELECT hs.security_id, ex_date, round(shares * value, 4) AS cash FROM hs JOIN ca ON ca.security_id = hs.security_id AND action_type = 'cash_dividend' AND start_date < ex_date AND ex_date <= end_date")
def dividend_cash(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.dividend_cash(_held(spark, d), V.corporate_actions(spark, d)), 4)


@query(V.with_sql(V.SECURITIES) + """, hs AS (SELECT security_id, first_trade_date AS start_date, 7.0 AS shares, delisting_date, coalesce(delisting_return, -1) AS r FROM sec WHERE delisting_date IS NOT NULL)
SELECT hs.security_id, delisting_date, round(shares * close * (1 + r), 4)::DOUBLE AS proceeds FROM hs ASOF LEFT JOIN px ON px.security_id = hs.security_id AND px.observation_date <= hs.delisting_date""")
def delisting_proceeds(spark: SparkSession, d: str) -> DataFrame:
    """What seven shares of each delisted name brought."""
    s = written(V.securities(spark, d), "securities")
    held = s.select("security_id", F.col("first_trade_date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(7.0).alias("shares"))
    return rounded(trades.delisting_proceeds(held, s, V.prices(spark, d)), 4)


_BOOK = V.with_sql() + """,
qt AS (SELECT security_id, arg_max(close, observation_date) AS price, arg_max(dollar_volume, observation_date) AS adv FROM px GROUP BY 1),
bk AS (SELECT security_id, price, adv, CASE WHEN security_id % 3 <> 0 THEN 0.01 * (1 + security_id % 4) ELSE 0 END AS tw, CASE WHEN security_id % 4 <> 1 THEN 0.02 ELSE 0 END AS cw, CASE WHEN security_id % 4 <> 1 THEN 3.0 + security_id % 7 ELSE 0 END AS owned,
    (security_id % 3 <> 0 OR security_id % 4 <> 1) AS named FROM qt),
od AS (SELECT *, greatest((tw - cw) * 100000 / price, -owned) AS shares FROM bk WHERE named AND price > 0),
op AS (SELECT security_id, CASE WHEN shares < 0 THEN 'sell' ELSE 'buy' END AS side, abs(shares) AS quantity, tw, cw, price, adv, abs(shares * price) AS notional FROM od WHERE abs(shares * price) > 50)"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    bars = V.prices(spark, d)
    k = F.col("security_id")
    quotes = written(bars.groupBy("security_id").agg(F.max_by("close", "observation_date").alias("price"), F.max_by("dollar_volume", "observation_date").alias("adv")).withColumn("volatility", F.lit(0.02)), "quotes")
    targets = quotes.where("security_id % 3 <> 0").select(k, (0.01 * (F.pmod(k, F.lit(4)) + 1)).alias("weight"))
    current = quotes.where("security_id % 4 <> 1").select(k, F.lit(0.02).alias("weight"), (F.pmod(k, F.lit(7)) + 3.0).alias("quantity"))
    return ledger.proposals(targets, current, quotes, 100_000.0, 50.0).join(quotes.select("security_id", "adv"), "security_id")


@query(_BOOK + " SELECT security_id, side, round(quantity, 6) AS quantity, round(tw, 6)::DOUBLE AS target_weight, round(cw, 6)::DOUBLE AS current_weight, round(notional, 4) AS notional FROM op")
def order_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Orders from target and current weights; sells are held to what is owned, small trades are left out."""
    o = _orders(spark, d)
    return o.select("security_id", "side", *[F.round(c, 6).alias(c) for c in ("quantity", "target_weight", "current_weight")], F.round("notional", 4).alias("notional"))


@query(_BOOK + """ SELECT security_id, round(least(quantity, CASE WHEN adv > 0 THEN adv * 0.05 / price ELSE quantity END), 6) AS filled_quantity, least(quantity, CASE WHEN adv > 0 THEN adv * 0.05 / price ELSE quantity END) < quantity AS partial FROM op""")
def participation_cap(spark: SparkSession, d: str) -> DataFrame:
    """Orders held to a twentieth of the last day's volume."""
    return ledger.participation_capped(_orders(spark, d), 0.05).select("security_id", F.round("filled_quantity", 6).alias("filled_quantity"), "partial")


@query(_BOOK + """ SELECT count(*) AS n_orders, count(*) FILTER (WHERE side = 'buy') AS n_buys, count(*) FILTER (WHERE side = 'sell') AS n_sells, round(sum(notional), 4) AS traded, round(sum(abs(tw - cw)) / 2, 6)::DOUBLE AS turnover,
 (SELECT count(*) FROM bk WHERE security_id % 3 <> 0) AS n_targets FROM op""")
def rebalance_record(spark: SparkSession, d: str) -> DataFrame:
    """The record of one rebalance: counts, traded notional, turnover and its target weights."""
    targets = V.prices(spark, d).select("security_id").distinct().where("security_id % 3 <> 0").withColumn("weight", 0.01 * (F.pmod("security_id", F.lit(4)) + 1))
    r = ledger.rebalance_record(_orders(spark, d), targets)
    return r.select("n_orders", "n_buys", "n_sells", F.round("traded", 4).alias("traded"), F.round("turnover", 6).alias("turnover"), F.size("target_weights").cast("long").alias("n_targets"))


@query(V.with_sql() + f""", rr AS (SELECT security_id, close / lag(close) OVER ({_W}) - 1 AS r FROM px) SELECT security_id, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM rr WHERE r IS NOT NULL GROUP BY 1""")
def realised_volatility(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    r = risk.trailing_returns(p, date(2100, 1, 1), 1_000_000)
    return rounded(risk.realised_volatility(r))


_RANKED = _FEAT + f""", lg AS (SELECT security_id, as_of, unnest(['momentum_21d', 'volatility_20d', 'adv_21d']) AS model, unnest([momentum_21d, volatility_20d, adv_21d]) AS x FROM fx),
rk AS (SELECT model, security_id, as_of, {_ar('x', 'model, as_of')} / count(*) OVER (PARTITION BY model, as_of) AS r FROM lg WHERE x IS NOT NULL)"""


@query(_RANKED + """, pc AS (SELECT a.model AS m1, b.model AS m2, a.as_of, corr(a.r, b.r) AS c FROM rk a JOIN rk b USING (security_id, as_of) WHERE a.model < b.model GROUP BY 1, 2, 3)
SELECT round(1 - avg(c) FILTER (WHERE NOT isnan(c)), 6) AS disagreement FROM pc""")
def member_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """How far three single-factor models rank apart."""
    f = written(feature_panel(spark, d), "features")
    members = None
    for c in FACTORS:
        one = models.ranked(f.where(F.col(c).isNotNull()).select("security_id", "as_of", F.col(c).alias("prediction"))).select(F.lit(c).alias("model"), "security_id", "as_of", "cross_sectional_rank")
        members = one if members is None else members.unionByName(one)
    return rounded(models.disagreement(written(members, "members")))


_LOG = "WITH lg AS (SELECT user_id AS run_id, ts AS t, event_id, CASE WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'click' THEN 'FAILED' ELSE 'RUNNING' END AS state FROM events), st AS (SELECT run_id, arg_max(state, t) AS s0, max(t) AS t FROM lg GROUP BY 1), sl AS (SELECT run_id, CASE WHEN s0 = 'RUNNING' AND t < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR THEN 'FAILED' ELSE s0 END AS state, t FROM st)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "click", "FAILED").otherwise("RUNNING")
    return V.table(spark, d, "events").select(F.col("user_id").alias("run_id"), state.alias("state"), F.col("ts").cast("timestamp").alias("at"))


@query(_LOG + " SELECT run_id, state, t AS at FROM sl")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each run, those that say RUNNING for more than six hours failed."""
    return results.run_states(_log(spark, d), datetime(2024, 1, 30, 12)).select("run_id", "state", F.col("at").cast("timestamp_ntz").alias("at"))


@query(_LOG + " SELECT s0 AS state, count(*) AS n FROM st GROUP BY 1")
def run_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return results.status_counts(_log(spark, d))


@query(_LOG + " SELECT run_id, s0 AS state, t AS at FROM st WHERE s0 = 'COMPLETED' ORDER BY t DESC, run_id LIMIT 10 OFFSET 5")
def run_listing(spark: SparkSession, d: str) -> DataFrame:
    """A page of the completed runs, newest first."""
    return results.list_runs(_log(spark, d), "COMPLETED", 10, 5).select("run_id", "state", F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT user_id AS run_id, event_type AS \"table\", count(*) AS n FROM events GROUP BY 1, 2")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by run and table, each kind of event a table."""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_type")
    kinds = [r["event_type"] for r in e.select("event_type").distinct().collect()]  # a few kinds
    return results.run_counts({k: e.where(F.col("event_type") == k) for k in kinds})
