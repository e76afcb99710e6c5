"""Queries over calendars, identity, labels, universe, data quality, preprocessing and splits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import asof, calendar, checks, identity, labels, preprocess, splits, universe
from panelspark.operators.features_price import price_features
from panelspark.plans import views as V
from panelspark.plans.features import _W, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["momentum_21d", "volatility_20d", "adv_21d"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE y AS (SELECT unnest(range((SELECT min(year(l_shipdate)) FROM lineitem)::INT, (SELECT max(year(l_shipdate)) FROM lineitem)::INT + 2)) AS y), h0 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h1 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM h0), h2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM h1),
h3 AS (SELECT *, (a + 11 * h + 22 * m) // 451 AS n FROM h2), e AS (SELECT y, make_date(y, (h + m - 7 * n + 114) // 31, (h + m - 7 * n + 114) % 31 + 1) AS easter FROM h3),
f AS (SELECT y, unnest([make_date(y, 7, 4), make_date(y, 12, 25)]) AS d FROM y),
hol AS (SELECT CASE dayofweek(d) WHEN 0 THEN d + 1 WHEN 6 THEN d - 1 ELSE d END AS d FROM f
  UNION ALL SELECT CASE dayofweek(make_date(y, 1, 1)) WHEN 0 THEN make_date(y, 1, 2) ELSE make_date(y, 1, 1) END FROM y UNION ALL SELECT easter - 2 FROM e
  UNION ALL SELECT make_date(y, 9, 1) + ((8 - dayofweek(make_date(y, 9, 1))) % 7)::INT FROM y
  UNION ALL SELECT make_date(y, 11, 1) + ((11 - dayofweek(make_date(y, 11, 1))) % 7 + 21)::INT FROM y
  UNION ALL SELECT make_date(y, 2, 1) + ((8 - dayofweek(make_date(y, 2, 1))) % 7 + 14)::INT FROM y
  UNION ALL SELECT make_date(y, 1, 1) + ((8 - dayofweek(make_date(y, 1, 1))) % 7 + 14)::INT FROM y WHERE y >= 1998
  UNION ALL SELECT make_date(y, 5, 31) - ((dayofweek(make_date(y, 5, 31)) + 6) % 7)::INT FROM y),
s AS (SELECT d::DATE AS session FROM generate_series((SELECT min(l_shipdate) FROM lineitem), (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 DAY) t(d)
  WHERE dayofweek(d) NOT IN (0, 6) AND d::DATE NOT IN (SELECT d FROM hol))
SELECT session, row_number() OVER (ORDER BY session)::INT - 1 AS idx FROM s""")
def session_table(spark: SparkSession, d: str) -> DataFrame:
    """Exchange sessions over the span of the data."""
    lo, hi = V.table(spark, d, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return calendar.sessions(spark, lo, hi)


@query(V.with_sql(V.SESSIONS) + """
SELECT 'weekly' AS rule, max(session) AS rebalance_date FROM cal GROUP BY isoyear(session), weekofyear(session)
UNION ALL SELECT 'weekly_first', min(session) FROM cal GROUP BY isoyear(session), weekofyear(session) UNION ALL SELECT 'monthly', max(session) FROM cal GROUP BY date_trunc('month', session)""")
def rebalance_dates(spark: SparkSession, d: str) -> DataFrame:
    cal = V.sessions(spark, d)
    out = [calendar.rebalance_dates(cal, r).select(F.lit(r).alias("rule"), "rebalance_date") for r in ("weekly", "weekly_first", "monthly")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(V.with_sql(V.SESSIONS) + """, r AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), a AS (SELECT day, min(idx) AS idx FROM r LEFT JOIN cal ON session >= day GROUP BY day)
SELECT day, cal.session AS shifted FROM a LEFT JOIN cal ON cal.idx = a.idx + 5""")
def session_shift(spark: SparkSession, d: str) -> DataFrame:
    """Five sessions after each order day; days between sessions count as the next one."""
    days = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return calendar.shifted(days, V.sessions(spark, d), "day", 5)


_RENAMES = """rn AS (SELECT s_suppkey AS security_id, unnest([DATE '1996-05-01', DATE '1999-03-15']) AS ex_date, unnest(['S' || s_suppkey, 'T' || s_suppkey]) AS old_symbol, unnest(['T' || s_suppkey, 'U' || s_suppkey]) AS new_symbol FROM supplier WHERE s_suppkey % 3 = 0),
iv AS (SELECT security_id, new_symbol AS symbol, ex_date AS start_date, coalesce(lead(ex_date) OVER (PARTITION BY security_id ORDER BY ex_date), DATE '9999-12-31') AS end_date FROM rn
  UNION ALL SELECT security_id, old_symbol, DATE '1900-01-01', ex_date FROM rn WHERE old_symbol LIKE 'S%')"""


def _renames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = lambda day, a, b: F.struct(F.lit(day).alias("ex_date"), F.concat(F.lit(a), k).alias("old_symbol"), F.concat(F.lit(b), k).alias("new_symbol"))
    s = V.table(spark, d, "supplier").where(k % 3 == 0)
    rows = s.select(k.alias("security_id"), F.explode(F.array(one(date(1996, 5, 1), "S", "T"), one(date(1999, 3, 15), "T", "U"))).alias("e"))
    return rows.select("security_id", F.lit("symbol_change").alias("action_type"), "e.*")


@query("WITH " + _RENAMES + " SELECT * FROM iv")
def rename_intervals(spark: SparkSession, d: str) -> DataFrame:
    return identity.rename_intervals(_renames(spark, d))


@query(V.with_sql(V.MONTH_ENDS, _RENAMES) + " SELECT iv.symbol, me.as_of, iv.security_id FROM iv JOIN me ON iv.start_date <= me.as_of AND me.as_of < iv.end_date WHERE iv.symbol LIKE 'T%'")
def resolve_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Which security bore each second symbol at each month end."""
    i = identity.rename_intervals(_renames(spark, d)).withColumnRenamed("symbol", "identifier_value").withColumn("is_primary", F.lit(True))
    wanted = i.where("identifier_value LIKE 'T%'").select(F.col("identifier_value").alias("symbol")).distinct().crossJoin(F.broadcast(V.month_ends(spark, d)))
    return identity.resolve(wanted, i).where("security_id IS NOT NULL")


_LABELS = V.with_sql(V.BENCH, V.SECURITIES) + """,
cb AS (SELECT observation_date AS d, lead(observation_date, 1) OVER o AS ws, lead(observation_date, 22) OVER o AS we, lead(close, 22) OVER o / lead(close, 1) OVER o - 1 AS b FROM bm WINDOW o AS (ORDER BY observation_date)),
g AS (SELECT i.security_id, bm.observation_date AS d, last_value(px.close IGNORE NULLS) OVER (PARTITION BY i.security_id ORDER BY bm.observation_date) AS p
  FROM (SELECT DISTINCT security_id FROM px) i CROSS JOIN bm LEFT JOIN px ON px.security_id = i.security_id AND px.observation_date = bm.observation_date),
h AS (SELECT g.*, lead(p, 1) OVER o AS pin, lead(p, 22) OVER o AS pout FROM g WINDOW o AS (PARTITION BY security_id ORDER BY d)),
l0 AS (SELECT h.security_id, h.d AS as_of, cb.ws, cb.we, cb.b, pout / pin - 1 AS pr, sec.delisting_date AS dd, sec.delisting_return AS dr,
    coalesce(sec.delisting_date > h.d AND sec.delisting_date <= cb.we, false) AS dies FROM h JOIN cb USING (d) LEFT JOIN sec USING (security_id) WHERE sec.delisting_date IS NULL OR h.d < sec.delisting_date),
l1 AS (SELECT security_id, as_of, CASE WHEN dies THEN least(ws, dd) ELSE ws END AS window_start, CASE WHEN dies THEN dd ELSE we END AS window_end,
    CASE WHEN dies THEN (1 + coalesce(pr, 0)) * (1 + coalesce(dr, -1)) - 1 ELSE pr END AS raw_return, b AS benchmark_return, dies AS is_delisted FROM l0),
l2 AS (SELECT *, raw_return - benchmark_return AS excess_return FROM l1 WHERE raw_return - benchmark_return IS NOT NULL AND window_start IS NOT NULL AND window_end IS NOT NULL)"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.forward_labels(V.prices(spark, d), V.benchmark(spark, d), V.securities(spark, d), 21, 1, V.month_ends(spark, d))


@query(_LABELS + f""", {V.MONTH_ENDS}, z AS (SELECT * FROM l2 WHERE as_of IN (SELECT as_of FROM me))
SELECT security_id, as_of, window_start, window_end, round(raw_return, 6) AS raw_return, round(excess_return, 6) AS excess_return, is_delisted,
 round((rank() OVER (PARTITION BY as_of ORDER BY excess_return) + (count(*) OVER (PARTITION BY as_of, excess_return) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of), 6) AS excess_rank, (excess_return > 0)::INT::DOUBLE AS outperform FROM z""")
def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels over 21 sessions after a delay of one, at month ends, ranked by date."""
    return rounded(_labels(spark, d).select("security_id", "as_of", "window_start", "window_end", "raw_return", "excess_return", "is_delisted", "excess_rank", "outperform"))


@query(_LABELS + " SELECT security_id, as_of, window_start, window_end, round(raw_return, 6) AS raw_return FROM l2 WHERE is_delisted")
def delisting_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose window holds a delisting, on every session."""
    out = labels.forward_labels(V.prices(spark, d), V.benchmark(spark, d), V.securities(spark, d))
    return rounded(out.where("is_delisted").select("security_id", "as_of", "window_start", "window_end", "raw_return"))


_SCREENS = universe.Screens(least_history=126, least_price=5.0, least_adv=10_000.0, most_age_days=15, excluded_sectors=("AFRICA",))
_UNIVERSE = V.with_sql(V.SECURITIES, V.MEMBERSHIP, V.MONTH_ENDS) + f""",
bs AS (SELECT security_id, observation_date AS bar, close, count(close) OVER ({_W}) AS history, avg(dollar_volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS adv FROM px),
mm AS (SELECT DISTINCT me.as_of, mem.security_id FROM mem JOIN me ON start_date <= me.as_of AND me.as_of < end_date AND available_at < me.as_of + 1),
sc AS (SELECT mm.*, sec.sector, first_trade_date, delisting_date, bar, close, history, adv FROM mm LEFT JOIN sec USING (security_id) ASOF LEFT JOIN bs ON bs.security_id = mm.security_id AND bs.bar <= mm.as_of),
ex AS (SELECT *, CASE WHEN sector = 'AFRICA' THEN 'sector' WHEN first_trade_date > as_of OR delisting_date <= as_of THEN 'not_listed' WHEN bar IS NULL THEN 'no_prices' WHEN history < 126 THEN 'history'
   WHEN coalesce(close < 5, true) THEN 'price' WHEN coalesce(adv < 10000, true) THEN 'liquidity' WHEN as_of - bar > 15 THEN 'stale' END AS rule FROM sc)"""


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return universe.screened(V.month_ends(spark, d), V.membership(spark, d), V.securities(spark, d), V.prices(spark, d), _SCREENS)


def _universe(spark: SparkSession, d: str) -> DataFrame:
    return universe.universe_panel(V.month_ends(spark, d), V.membership(spark, d), V.securities(spark, d), V.prices(spark, d), _SCREENS)


@query(_UNIVERSE + " SELECT as_of, security_id, sector, round(adv, 2) AS adv FROM ex WHERE rule IS NULL")
def universe_panel(spark: SparkSession, d: str) -> DataFrame:
    return _universe(spark, d).select("as_of", "security_id", "sector", F.round("adv", 2).alias("adv"))


@query(_UNIVERSE + " SELECT as_of, coalesce(rule, 'eligible') AS rule, count(*) AS n FROM ex GROUP BY 1, 2")
def universe_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return universe.exclusion_report(_screened(spark, d))


@query(V.with_sql(V.SESSIONS, V.MEMBERSHIP) + f""", x AS (SELECT *, abs(close / lag(close) OVER ({_W}) - 1) AS r FROM px), lastd AS (SELECT security_id, max(observation_date) AS l FROM px GROUP BY 1),
f AS (SELECT 'extreme_return' AS "check", 'warning' AS severity, count(*) AS n FROM x WHERE r > 0.05
UNION ALL SELECT 'stale_observations', 'warning', count(*) FROM lastd WHERE l < (SELECT min(session) FROM (SELECT session FROM cal ORDER BY session DESC LIMIT 11))
UNION ALL SELECT 'invalid_price', 'critical', count(*) FROM px WHERE close <= 0 UNION ALL SELECT 'invalid_ohlc', 'critical', count(*) FROM px WHERE high < low
UNION ALL SELECT 'invalid_volume', 'critical', count(*) FROM px WHERE volume < 0
UNION ALL SELECT 'duplicate_records', 'critical', count(*) FROM (SELECT l_suppkey, l_shipdate FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'membership_overlap', 'critical', count(*) FROM (SELECT end_date, lead(start_date) OVER (PARTITION BY security_id ORDER BY start_date, end_date) AS nx FROM mem) WHERE nx < end_date)
SELECT * FROM f WHERE n > 0""")
def dq_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings over the derived bars, the raw lines (duplicates by supplier and day) and the membership."""
    p = V.prices(spark, d)
    lines = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("observation_date"))
    parts = [checks.duplicate_records(lines, ["security_id", "observation_date"], "lines"), checks.price_values(p), checks.extreme_returns(p, 0.05), checks.stale(p, V.sessions(spark, d)), checks.membership_overlap(V.membership(spark, d))]
    return checks.report(*parts).select("check", "severity", "n")


_FEAT = V.with_sql(V.BENCH, V.MONTH_ENDS, V.SECURITIES) + f""",
q0 AS (SELECT px.*, ln(close) - lag(ln(close)) OVER ({_W}) AS r, ln(close) - lag(ln(close), 21) OVER ({_W}) AS momentum_21d FROM px),
q1 AS (SELECT security_id, observation_date AS as_of, momentum_21d, CASE WHEN count(r) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 16 THEN stddev_samp(r) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END AS volatility_20d,
  CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) >= 15 THEN ln(1 + avg(dollar_volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) END AS adv_21d FROM q0),
fx AS (SELECT q1.* FROM q1 WHERE as_of IN (SELECT as_of FROM me))"""


def feature_panel(spark: SparkSession, d: str) -> DataFrame:
    """Three features on the month ends on which a security traded."""
    f = price_features(V.prices(spark, d), V.benchmark(spark, d))
    return f.join(F.broadcast(V.month_ends(spark, d)), "as_of", "left_semi").select("security_id", "as_of", *FEATURES)


_CUT = date(1998, 6, 30)
_ST = """, tr AS (SELECT * FROM fx WHERE as_of < DATE '1998-06-30'),
st AS (SELECT quantile_cont(momentum_21d, 0.01) AS lo, quantile_cont(momentum_21d, 0.99) AS hi, median(momentum_21d) AS md FROM tr)"""


@query(_FEAT + _ST + """, w AS (SELECT security_id, as_of, CASE WHEN momentum_21d IS NOT NULL THEN least(greatest(momentum_21d, lo), hi) END AS x, md FROM fx, st),
i AS (SELECT security_id, as_of, coalesce(x, median(x) OVER (PARTITION BY as_of), md) AS x FROM w)
SELECT security_id, as_of, round((rank() OVER (PARTITION BY as_of ORDER BY x) + (count(*) OVER (PARTITION BY as_of, x) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY as_of) - 0.5, 6) AS momentum_21d FROM i""")
def preprocess_rank(spark: SparkSession, d: str) -> DataFrame:
    """Bounds and medians from training rows, then winsorized, imputed and rank-normalised by date."""
    f = feature_panel(spark, d).select("security_id", "as_of", "momentum_21d")
    stats = preprocess.fit(f.where(F.col("as_of") < F.lit(_CUT)), ["momentum_21d"])
    return rounded(preprocess.apply(f, stats, ["momentum_21d"], "rank", flags=False))


@query(_FEAT + """, a AS (SELECT security_id, as_of, volatility_20d AS x, median(volatility_20d) OVER (PARTITION BY as_of) AS m FROM fx WHERE volatility_20d IS NOT NULL),
b AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY as_of) AS dv FROM a)
SELECT security_id, as_of, round(least(greatest((x - m) / (dv * 1.4826 + 1e-12), -5), 5), 6) AS volatility_20d FROM b""")
def preprocess_robust_z(spark: SparkSession, d: str) -> DataFrame:
    f = feature_panel(spark, d).select("security_id", "as_of", "volatility_20d").where("volatility_20d IS NOT NULL")
    return rounded(preprocess.robust_z(f, ["volatility_20d"]))


@query(_FEAT + " SELECT fx.security_id, as_of, sector, round(adv_21d - avg(adv_21d) OVER (PARTITION BY as_of, sector), 6) AS adv_21d FROM fx JOIN sec USING (security_id)")
def neutralize_sector(spark: SparkSession, d: str) -> DataFrame:
    f = feature_panel(spark, d).join(V.securities(spark, d).select("security_id", "sector"), "security_id")
    return rounded(preprocess.neutralize(f.select("security_id", "as_of", "sector", "adv_21d"), ["adv_21d"], "sector"))


_FOLDS = """fd AS (SELECT i AS fold, DATE '1995-01-02' AS a, DATE '1995-01-02' + 1096 + (i * 180)::INT AS v0, DATE '1995-01-02' + 1096 + (i * 180)::INT + 180 AS t0, DATE '1995-01-02' + 1096 + (i * 180)::INT + 360 AS t1 FROM range(0, 7) r(i))"""


def _schedule(spark: SparkSession) -> DataFrame:
    return splits.folds(spark, date(1995, 1, 2), date(2001, 11, 30))


@query(_LABELS + f""", {V.MONTH_ENDS}, {_FOLDS}, z AS (SELECT security_id, as_of, window_end FROM l2 WHERE as_of IN (SELECT as_of FROM me))
SELECT fold::INT AS fold, CASE WHEN as_of < v0 THEN 'train' WHEN as_of < t0 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(as_of) AS first, max(as_of) AS last
FROM z JOIN fd ON as_of >= a AND as_of < t1 GROUP BY 1, 2""")
def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows by fold and split without purge or embargo."""
    s = splits.split_panel(_labels(spark, d), _schedule(spark), purge=False)
    return s.groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))


@query(_LABELS + f""", {V.MONTH_ENDS}, {V.SESSIONS}, {_FOLDS}, z AS (SELECT security_id, as_of, window_end FROM l2 WHERE as_of IN (SELECT as_of FROM me)),
em AS (SELECT fold, a, v0, t0, t1, (SELECT c2.session FROM cal c1, cal c2 WHERE c1.session >= v0 AND c2.idx = c1.idx - 5 ORDER BY c1.session LIMIT 1) AS edge FROM fd),
y AS (SELECT fold, CASE WHEN as_of < v0 THEN CASE WHEN as_of < edge AND window_end < v0 THEN 'train' END WHEN as_of < t0 THEN CASE WHEN window_end < t0 THEN 'validation' END ELSE 'test' END AS split, security_id, as_of FROM z JOIN em ON as_of >= a AND as_of < t1)
SELECT fold::INT AS fold, split, count(*) AS n, max(as_of) AS last FROM y WHERE split IS NOT NULL GROUP BY 1, 2""")
def purge_embargo_rows(spark: SparkSession, d: str) -> DataFrame:
    s = splits.split_panel(_labels(spark, d), _schedule(spark), V.sessions(spark, d), embargo=5)
    return s.groupBy("fold", "split").agg(F.count("*").alias("n"), F.max("as_of").alias("last"))


@query(_LABELS + f""", {V.MONTH_ENDS}, {V.SESSIONS}, {_FOLDS}, z AS (SELECT security_id, as_of, window_end FROM l2 WHERE as_of IN (SELECT as_of FROM me)),
em AS (SELECT fold, a, v0, t0, t1, (SELECT c2.session FROM cal c1, cal c2 WHERE c1.session >= v0 AND c2.idx = c1.idx - 5 ORDER BY c1.session LIMIT 1) AS edge FROM fd),
y AS (SELECT fold, a, v0, t0, t1, window_end, CASE WHEN as_of < v0 THEN CASE WHEN as_of < edge AND window_end < v0 THEN 'train' END WHEN as_of < t0 THEN CASE WHEN window_end < t0 THEN 'validation' END ELSE 'test' END AS split, as_of FROM z JOIN em ON as_of >= a AND as_of < t1)
SELECT fold::INT AS fold, split, count(*) AS n, min(as_of) AS first, max(as_of) AS last,
 min(as_of) >= CASE split WHEN 'train' THEN a WHEN 'validation' THEN v0 ELSE t0 END AND max(as_of) < CASE split WHEN 'train' THEN v0 WHEN 'validation' THEN t0 ELSE t1 END AND (split <> 'train' OR max(window_end) < v0) AS ok
FROM y WHERE split IS NOT NULL GROUP BY fold, split, a, v0, t0, t1""")
def fold_safety(spark: SparkSession, d: str) -> DataFrame:
    """The safety report of purged folds."""
    s = splits.split_panel(_labels(spark, d), _schedule(spark), V.sessions(spark, d), embargo=5)
    return splits.fold_report(s, _schedule(spark))


@query(V.with_sql(V.ACTIONS) + """ SELECT ca.security_id, ca.ex_date, p.observation_date AS bar, round(p.close + 1e-8, 6) AS close FROM (SELECT * FROM ca WHERE action_type = 'cash_dividend') ca
ASOF LEFT JOIN px p ON p.security_id = ca.security_id AND p.observation_date < ca.ex_date""")
def last_close_before_ex_date(spark: SparkSession, d: str) -> DataFrame:
    cash = V.corporate_actions(spark, d).where("action_type = 'cash_dividend'").select("security_id", "ex_date")
    bars = V.prices(spark, d).select("security_id", F.col("observation_date").alias("bar"), "close")
    out = asof.as_of_join(cash, bars, "security_id", "ex_date", "bar", strict=True)
    return out.withColumn("close", F.round(F.col("close") + 1e-8, 6))


@query(V.with_sql(V.SECURITIES) + " SELECT security_id, sector, delisting_date FROM sec WHERE first_trade_date <= DATE '1998-01-01' AND (delisting_date IS NULL OR delisting_date > DATE '1998-01-01')")
def listed_on_date(spark: SparkSession, d: str) -> DataFrame:
    return identity.listed_on(V.securities(spark, d), date(1998, 1, 1)).select("security_id", "sector", "delisting_date")

