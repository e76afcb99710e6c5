"""Queries over price, fundamental and macro features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import average_rank
from panelspark.operators import asof, corpactions, features_fund, features_macro
from panelspark.operators.features_price import price_features
from panelspark.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_W = "PARTITION BY security_id ORDER BY observation_date"


def _rows(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_R = V.with_sql(V.BENCH) + f""",
r0 AS (SELECT px.*, ln(px.close) AS lp, ln(px.close) - lag(ln(px.close)) OVER ({_W}) AS r FROM px),
br AS (SELECT observation_date, ln(close) - lag(ln(close)) OVER (ORDER BY observation_date) AS b FROM bm),
r1 AS (SELECT r0.*, br.b FROM r0 LEFT JOIN br USING (observation_date))"""


def _roll(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_rows(n)} >= {least} THEN {agg.format(x)} OVER {_rows(n)} END"


@query(V.with_sql(V.MONTH_ENDS, V.SECURITIES) + f"""
, m AS (SELECT security_id, observation_date AS bar, close, ln(close) - lag(ln(close), 21) OVER ({_W}) AS momentum_21d, count(close) OVER ({_W}) AS history FROM px),
a AS (SELECT me.as_of, m.* FROM me JOIN m ON m.bar <= me.as_of AND m.bar >= me.as_of - 10
  QUALIFY row_number() OVER (PARTITION BY me.as_of, m.security_id ORDER BY m.bar DESC) = 1),
e AS (SELECT * FROM a WHERE close >= 5 AND history >= 63 AND momentum_21d IS NOT NULL),
k AS (SELECT as_of, security_id, momentum_21d, (rank() OVER (PARTITION BY as_of ORDER BY momentum_21d)
    + (count(*) OVER (PARTITION BY as_of, momentum_21d) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of) AS rank FROM e)
SELECT as_of, security_id, round(momentum_21d, 6) AS momentum_21d, round(rank, 6) AS rank FROM k
QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY k.rank DESC, security_id) <= 10""")
def momentum_top10_month_end(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest 21-row momenta among eligible names at each month end."""
    f = price_features(V.prices(spark, d), families=["momentum"], carry=["close"])
    w = Window.partitionBy("security_id").orderBy("as_of")
    state = f.select("security_id", F.col("as_of").alias("bar"), "close", "momentum_21d", F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("history"))
    ends = V.month_ends(spark, d)
    ids = state.select("security_id").distinct().crossJoin(F.broadcast(ends))
    a = asof.as_of_join(ids, state, "security_id", "as_of", "bar").where("bar >= date_sub(as_of, 10) AND close >= 5 AND history >= 63 AND momentum_21d IS NOT NULL")
    a = a.withColumn("rank", average_rank(F.col("momentum_21d"), "as_of") / F.count("*").over(Window.partitionBy("as_of")))
    top = a.withColumn("_n", F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("rank").desc(), "security_id"))).where("_n <= 10")
    return rounded(top.select("as_of", "security_id", "momentum_21d", "rank"))


@query(_R + f"""
SELECT security_id, observation_date AS as_of, round(-(lp - lag(lp, 5) OVER ({_W})), 6) AS reversal_5d, round(lp - lag(lp, 21) OVER ({_W}), 6) AS momentum_21d,
  round(lp - lag(lp, 252) OVER ({_W}), 6) AS momentum_252d, round(lag(lp, 21) OVER ({_W}) - lag(lp, 252) OVER ({_W}), 6) AS momentum_12m_ex1m,
  round(lp - ln({_roll('max({})', 'close', 252, 200)}), 6) AS dist_52w_high, round(lp - ln({_roll('avg({})', 'close', 50, 40)}), 6) AS ma_distance_50d,
  round({_roll('avg({})', '(r > 0)::INT::DOUBLE', 63, 50)}, 6) AS momentum_consistency_63d FROM r1""")
def returns_and_momentum(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(V.prices(spark, d), families=["momentum"])
    return rounded(f.select("security_id", "as_of", "reversal_5d", "momentum_21d", "momentum_252d", "momentum_12m_ex1m", "dist_52w_high", "ma_distance_50d", "momentum_consistency_63d"))


@query(_R + f""", n AS (SELECT *, row_number() OVER ({_W}) AS i FROM r1)
SELECT security_id, observation_date AS as_of, round(CASE WHEN count(lp) OVER {_rows(63)} >= 63 THEN regr_slope(lp, i) OVER {_rows(63)} / greatest(abs(lp), 0.1) END, 6) AS trend_slope_63d,
  round(CASE WHEN count(lp) OVER {_rows(63)} >= 63 THEN least(greatest(coalesce(regr_r2(lp, i) OVER {_rows(63)}, 0), 0), 1) END, 6) AS trend_r2_63d FROM n""")
def trend_slope_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(price_features(V.prices(spark, d), families=["momentum"]).select("security_id", "as_of", "trend_slope_63d", "trend_r2_63d"))


@query(_R + f"""
SELECT security_id, observation_date AS as_of, round({_roll('stddev_samp({})', 'r', 20, 16)} * sqrt(252), 6) AS volatility_20d, round({_roll('stddev_samp({})', 'r', 60, 48)} * sqrt(252), 6) AS volatility_60d,
  round({_roll('stddev_samp({})', 'r', 252, 201)} * sqrt(252), 6) AS volatility_252d, round({_roll('stddev_samp({})', '(CASE WHEN r < 0 THEN r END)', 60, 20)} * sqrt(252), 6) AS downside_vol_60d FROM r1""")
def volatility_family(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(V.prices(spark, d), V.benchmark(spark, d), ["risk"])
    return rounded(f.select("security_id", "as_of", "volatility_20d", "volatility_60d", "volatility_252d", "downside_vol_60d"))


@query(_R + f""", x AS (SELECT *, CASE WHEN b IS NOT NULL THEN r END AS rr, CASE WHEN r IS NOT NULL THEN b END AS bb FROM r1),
y AS (SELECT *, CASE WHEN count(rr) OVER {_rows(252)} >= 120 THEN regr_slope(rr, bb) OVER {_rows(252)} END AS beta, CASE WHEN count(rr) OVER {_rows(252)} >= 120 THEN corr(rr, bb) OVER {_rows(252)} END AS c FROM x)
SELECT security_id, observation_date AS as_of, round(beta, 6) AS beta_252d, round(c, 6) AS corr_benchmark_252d,
  round({_roll('stddev_samp({})', '(r - beta * b)', 252, 120)} * sqrt(252), 6) AS idio_vol_252d FROM y""")
def beta_corr_idio(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(V.prices(spark, d), V.benchmark(spark, d), ["risk"])
    return rounded(f.select("security_id", "as_of", "beta_252d", "corr_benchmark_252d", "idio_vol_252d"))


@query(_R + f""", x AS (SELECT *, {_roll('quantile_cont({}, 0.05)', 'r', 252, 120)} AS v, {_roll('max({})', 'close', 252, 120)} AS p FROM r1)
SELECT security_id, observation_date AS as_of, round(v, 6) AS var_95_252d, round({_roll('avg({})', '(CASE WHEN r <= v THEN r END)', 252, 6)}, 6) AS expected_shortfall_95_252d,
  round({_roll('min({})', '(close / p - 1)', 252, 120)}, 6) AS max_drawdown_252d FROM x""")
def var_es_drawdown(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(V.prices(spark, d), V.benchmark(spark, d), ["risk"])
    return rounded(f.select("security_id", "as_of", "var_95_252d", "expected_shortfall_95_252d", "max_drawdown_252d"))


@query(_R + f"""
SELECT security_id, observation_date AS as_of, round(ln(1 + {_roll('avg({})', 'dollar_volume', 21, 15)}), 6) AS adv_21d, round({_roll('avg({})', '(abs(r) / (dollar_volume + 1))', 21, 15)} * 1e3, 6) AS amihud_e6,
  round({_roll('avg({})', '(abs(r) < 1e-8)::INT::DOUBLE', 63, 40)}, 6) AS zero_return_freq_63d,
  round(ln(1 + {_roll('avg({})', 'volume', 21, 15)}) - ln(1 + {_roll('avg({})', 'volume', 63, 40)}), 6) AS volume_surprise_21d,
  round({_roll('avg({})', '((high - low) / close)', 21, 15)}, 6) AS spread_proxy_21d FROM r1""")
def liquidity_family(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(V.prices(spark, d), families=["liquidity"])
    amihud = (F.col("amihud_illiquidity_21d") / 1e6).alias("amihud_e6")
    return rounded(f.select("security_id", "as_of", "adv_21d", amihud, "zero_return_freq_63d", "volume_surprise_21d", "spread_proxy_21d"))


_F = "PARTITION BY security_id ORDER BY available_at, fiscal_period_end"
_TTM = V.with_sql(V.FUNDAMENTALS) + f""",
tt AS (SELECT *, CASE WHEN count(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 4 THEN sum(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS revenue_ttm,
   CASE WHEN count(net_income) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 4 THEN sum(net_income) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS net_income_ttm FROM fu WINDOW w AS ({_F})),
g AS (SELECT *, lag(revenue_ttm, 4) OVER (w) AS r4, lag(net_income_ttm, 4) OVER (w) AS n4, lag(total_assets, 4) OVER (w) AS a4 FROM tt WINDOW w AS ({_F}))"""


@query(_TTM + """
SELECT security_id, fiscal_period_end, round(revenue_ttm, 3) AS revenue_ttm, round(net_income_ttm, 3) AS net_income_ttm,
  round(CASE WHEN abs(r4) > 1e-6 THEN (revenue_ttm - r4) / abs(r4) END, 6) AS revenue_growth, round(CASE WHEN abs(n4) > 1e-6 THEN (net_income_ttm - n4) / abs(n4) END, 6) AS earnings_growth,
  round(CASE WHEN abs(a4) > 1e-6 THEN (total_assets - a4) / abs(a4) END, 6) AS asset_growth FROM g""")
def ttm_growth(spark: SparkSession, d: str) -> DataFrame:
    f = features_fund.filing_features(V.fundamentals(spark, d))
    out = f.select("security_id", "fiscal_period_end", "revenue_ttm", "net_income_ttm", "revenue_growth", "earnings_growth", "asset_growth")
    return rounded(out).withColumns({c: F.round(c, 3) for c in ("revenue_ttm", "net_income_ttm")})


_ASOF = _TTM + f""", {V.MONTH_ENDS},
an AS (SELECT i.security_id, me.as_of, g.* EXCLUDE (security_id) FROM (SELECT DISTINCT security_id FROM px) i CROSS JOIN me
  LEFT JOIN g ON g.security_id = i.security_id AND g.available_at <= me.as_of::TIMESTAMP
  QUALIFY row_number() OVER (PARTITION BY i.security_id, me.as_of ORDER BY g.available_at DESC NULLS LAST, g.fiscal_period_end DESC) = 1)"""


def _attached(spark: SparkSession, d: str) -> DataFrame:
    grid = V.prices(spark, d).select("security_id").distinct().crossJoin(F.broadcast(V.month_ends(spark, d)))
    return features_fund.attach(grid, features_fund.filing_features(V.fundamentals(spark, d)))


@query(_ASOF + " SELECT security_id, as_of, fiscal_period_end, filing_date, round(revenue, 2) AS revenue, round(total_assets, 2) AS total_assets FROM an")
def asof_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    """The latest filing known at midnight of each month end."""
    a = _attached(spark, d)
    return a.select("security_id", "as_of", "fiscal_period_end", "filing_date", F.round("revenue", 2).alias("revenue"), F.round("total_assets", 2).alias("total_assets"))


@query(_ASOF + """, q AS (SELECT an.*, p.close * 1e5 AS cap FROM an ASOF LEFT JOIN px p ON p.security_id = an.security_id AND p.observation_date <= an.as_of)
SELECT security_id, as_of, round(CASE WHEN abs(cap) > 1e-6 AND net_income_ttm IS NOT NULL THEN least(greatest(net_income_ttm / cap, -100), 100) END, 6) AS earnings_yield,
  round(CASE WHEN abs(cap) > 1e-6 AND revenue_ttm IS NOT NULL THEN least(greatest(revenue_ttm / cap, -100), 100) END, 6) AS sales_to_price, round(CASE WHEN abs(total_assets) > 1e-6 AND net_income_ttm IS NOT NULL THEN least(greatest(net_income_ttm / total_assets, -100), 100) END, 6) AS return_on_assets FROM q""")
def value_quality_ratios(spark: SparkSession, d: str) -> DataFrame:
    bars = V.prices(spark, d).select("security_id", F.col("observation_date").alias("bar"), F.col("close").alias("_close"))
    a = asof.as_of_join(_attached(spark, d), bars, "security_id", "as_of", "bar").withColumn("market_cap", F.col("_close") * 1e5)
    return rounded(features_fund.ratios(a).select("security_id", "as_of", "earnings_yield", "sales_to_price", "return_on_assets"))


@query(V.with_sql(V.MACRO, V.MONTH_ENDS) + """
SELECT me.as_of, round(arg_max(value, (available_at, observation_date, revision_id)), 2) AS "ORDERS" FROM me LEFT JOIN mac ON available_at <= me.as_of::TIMESTAMP AND value IS NOT NULL GROUP BY 1""")
def macro_vintage_asof(spark: SparkSession, d: str) -> DataFrame:
    out = features_macro.macro_as_of(V.month_ends(spark, d), V.macro(spark, d), ["ORDERS"])
    return out.select("as_of", F.round("ORDERS", 2).alias("ORDERS"))


@query(_R + f""", s AS (SELECT observation_date, (close > {_roll('avg({})', 'close', 50, 30)})::INT::DOUBLE AS up, lp - lag(lp, 21) OVER ({_W}) AS r21, r FROM r1),
t AS (SELECT observation_date AS as_of, avg(up) AS breadth, stddev_samp(r21) AS disp, avg(r) AS m, stddev_samp(r) AS sd FROM s GROUP BY 1),
u AS (SELECT *, CASE WHEN m IS NOT NULL AND sd IS NOT NULL THEN least(abs(m) / (sd + 1e-9), 10) END AS c FROM t)
SELECT as_of, round(breadth, 6) AS market_breadth, round(disp, 6) AS cross_sectional_dispersion,
  round(CASE WHEN count(c) OVER w >= 10 THEN avg(c) OVER w END, 6) AS average_correlation FROM u WINDOW w AS (ORDER BY as_of ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def market_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features_macro.market_state(V.prices(spark, d)))


@query(V.with_sql(V.BENCH) + """, z AS (SELECT *, ln(close) - lag(ln(close)) OVER (ORDER BY observation_date) AS r FROM bm)
SELECT observation_date AS as_of, round(CASE WHEN count(r) OVER a >= 15 THEN stddev_samp(r) OVER a END * sqrt(252), 6) AS market_vol_21d, round(CASE WHEN count(r) OVER b >= 40 THEN stddev_samp(r) OVER b END * sqrt(252), 6) AS market_vol_63d,
  round(ln(close) - lag(ln(close), 126) OVER (ORDER BY observation_date), 6) AS market_trend_126d, round(close / CASE WHEN count(close) OVER c >= 60 THEN max(close) OVER c END - 1, 6) AS market_drawdown
FROM z WINDOW a AS (ORDER BY observation_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), b AS (ORDER BY observation_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), c AS (ORDER BY observation_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def benchmark_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features_macro.benchmark_regime(V.benchmark(spark, d)))


_ADJ = V.with_sql(V.ACTIONS) + """,
dv AS (SELECT ca.*, p.close AS before FROM (SELECT * FROM ca WHERE action_type = 'cash_dividend') ca ASOF JOIN px p ON p.security_id = ca.security_id AND p.observation_date < ca.ex_date),
ev AS (SELECT security_id, ex_date, 1 / value AS f, 's' AS k FROM ca WHERE action_type = 'stock_split'
  UNION ALL SELECT security_id, ex_date, least(greatest(1 - value / before, 1e-6), 1), 'd' FROM dv),
ad AS (SELECT px.security_id, px.observation_date, any_value(px.close) AS close, coalesce(product(f) FILTER (WHERE k = 's'), 1) AS split_factor, coalesce(product(f) FILTER (WHERE k = 'd'), 1) AS dividend_factor
  FROM px LEFT JOIN ev ON ev.security_id = px.security_id AND ev.ex_date > px.observation_date GROUP BY 1, 2)"""


@query(_ADJ + " SELECT security_id, observation_date, round(split_factor, 6) AS split_factor, round(dividend_factor, 6) AS dividend_factor, round(close * split_factor * dividend_factor + 1e-8, 6) AS adjusted_close FROM ad")
def split_dividend_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Back-adjusted closes; the SQL is the definition by a range join, the query one suffix window."""
    a = corpactions.adjusted_prices(V.prices(spark, d).drop("adjusted_close"), V.corporate_actions(spark, d))
    return a.select("security_id", "observation_date", F.round("split_factor", 6).alias("split_factor"), F.round("dividend_factor", 6).alias("dividend_factor"), F.round(F.col("adjusted_close") + 1e-8, 6).alias("adjusted_close"))
