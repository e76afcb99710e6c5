"""Queries over scores, statistics, risk, models and results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import nearest
from panelspark.operators import ablation, factors, labels, metrics, models, overfit, panel, preprocess, results, risk, scorecard, splits, stress, universe, walkforward
from panelspark.operators.features_price import price_features
from panelspark.plans import views as V
from panelspark.plans.features import _W, rounded
from panelspark.plans.states import _FEAT, _FOLDS, _LABELS, _SCREENS, _UNIVERSE, FEATURES, _labels, _schedule, feature_panel
from panelspark.sources import writers
from panelspark.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = date(2000, 6, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Features and the label at month ends, from bars that are worked out once; written once too."""
    p, b, me = _bars(spark, d)
    features = price_features(p, b).join(F.broadcast(me), "as_of", "left_semi").select("security_id", "as_of", *FEATURES)
    lab = labels.forward_labels(p, b, V.securities(spark, d, p), 21, 1, me)
    return written(features.join(lab.select("security_id", "as_of", "window_end", "excess_return", "outperform", "raw_return"), ["security_id", "as_of"]), "panel")


def _bars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, benchmark and month ends, each written once."""
    p = written(V.prices(spark, d), "prices")
    b = written(V.benchmark(spark, d, p), "benchmark")
    return p, b, written(b.groupBy(F.trunc("observation_date", "month")).agg(F.max("observation_date").alias("as_of")).select("as_of"), "month_ends")


_PANEL = _LABELS + ", " + _FEAT[len(V.with_sql(V.BENCH, V.MONTH_ENDS, V.SECURITIES)) + 1 :] .replace("FROM q1 WHERE as_of IN (SELECT as_of FROM me)", "FROM q1 WHERE as_of IN (SELECT max(observation_date) FROM li GROUP BY date_trunc('month', observation_date))") + """,
pn AS (SELECT fx.*, l2.excess_return, l2.raw_return FROM fx JOIN l2 USING (security_id, as_of))"""


_BUILT = _PANEL + f", {V.MEMBERSHIP}, {V.MONTH_ENDS}" + _UNIVERSE[len(V.with_sql(V.SECURITIES, V.MEMBERSHIP, V.MONTH_ENDS)) :]


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Universe, features and labels at month ends, from bars that are worked out once."""
    p, b, me = _bars(spark, d)
    s = written(V.securities(spark, d, p), "securities")
    names = universe.universe_panel(me, V.membership(spark, d, p), s, p, _SCREENS)
    features = price_features(p, b).join(F.broadcast(me), "as_of", "left_semi").select("security_id", "as_of", *FEATURES)
    return names, features, labels.forward_labels(p, b, s, 21, 1, me)


@query(_BUILT + """ SELECT u.as_of, u.security_id, u.sector, round(momentum_21d, 6) AS momentum_21d, round(volatility_20d, 6) AS volatility_20d, round(adv_21d, 6) AS adv_21d, window_end, round(l.excess_return, 6) AS excess_return
FROM ex u LEFT JOIN fx ON fx.security_id = u.security_id AND fx.as_of = u.as_of JOIN l2 l ON l.security_id = u.security_id AND l.as_of = u.as_of WHERE rule IS NULL""")
def panel_build(spark: SparkSession, d: str) -> DataFrame:
    """The research panel: eligible names with features and labels at month ends."""
    out = panel.research_panel(*_parts(spark, d))
    return rounded(out.select("as_of", "security_id", "sector", *FEATURES, "window_end", "excess_return"))


@query(_BUILT + """ SELECT u.as_of, u.security_id, round(momentum_21d, 6) AS momentum_21d, round(adv_21d, 6) AS adv_21d FROM ex u LEFT JOIN fx ON fx.security_id = u.security_id AND fx.as_of = u.as_of
WHERE rule IS NULL AND u.as_of = (SELECT max(as_of) FROM ex WHERE rule IS NULL)""")
def scoring_panel(spark: SparkSession, d: str) -> DataFrame:
    """The newest date's eligible names with features, without labels."""
    names, features, _ = _parts(spark, d)
    return rounded(panel.latest(panel.scoring_panel(names, features)).select("as_of", "security_id", "momentum_21d", "adv_21d"))


def _ar(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


_LONG = _PANEL + """, lg AS (SELECT security_id, as_of, excess_return, factor, x FROM (SELECT security_id, as_of, excess_return, unnest(['momentum_21d', 'volatility_20d', 'adv_21d']) AS factor, unnest([momentum_21d, volatility_20d, adv_21d]) AS x FROM pn))"""
_IC = _LONG + f""", rk AS (SELECT *, {_ar('x', 'factor, as_of')} AS a, {_ar('excess_return', 'factor, as_of')} AS b FROM lg WHERE x IS NOT NULL),
ic AS (SELECT factor, as_of, count(*) AS n, corr(a, b) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 5)"""
FACTORS = ["momentum_21d", "volatility_20d", "adv_21d"]


def _long(spark: SparkSession, d: str) -> DataFrame:
    return factors.melted(_panel(spark, d), FACTORS, ["excess_return"])


@query(_IC + " SELECT factor, as_of, n, round(CASE WHEN isnan(ic) THEN NULL ELSE ic END, 6) AS ic FROM ic")
def ic_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.ic_series(_long(spark, d), "excess_return"))


@query(_IC + """, v AS (SELECT * FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic)) SELECT factor, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std,
 round(avg((ic > 1e-12)::INT::DOUBLE), 6) AS share_positive, count(*) AS periods, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir FROM v GROUP BY 1""")
def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ic_summary(factors.ic_series(_long(spark, d), "excess_return"), ["factor"]))


@query(_IC + " SELECT factor, year(as_of)::INT AS year, round(avg(CASE WHEN NOT isnan(ic) THEN ic END), 6) AS mean_ic, count(CASE WHEN NOT isnan(ic) THEN ic END) AS periods FROM ic GROUP BY 1, 2")
def subperiod_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.by_year(factors.ic_series(_long(spark, d), "excess_return")))


@query(_LONG + """, b AS (SELECT *, floor((row_number() OVER (PARTITION BY factor, as_of ORDER BY x, security_id) - 1) * 5 / count(*) OVER (PARTITION BY factor, as_of))::INT AS bucket FROM lg WHERE x IS NOT NULL),
m AS (SELECT factor, as_of, bucket, avg(excess_return) AS m FROM b GROUP BY ALL) SELECT factor, bucket, round(avg(m), 6) AS mean_return FROM m GROUP BY 1, 2""")
def quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.quantile_returns(_long(spark, d), "excess_return"))


@query(_LONG + """, k AS (SELECT *, row_number() OVER (PARTITION BY factor, as_of ORDER BY x DESC, security_id) AS i, greatest(floor(count(*) OVER (PARTITION BY factor, as_of) * 0.2), 1) AS k FROM lg WHERE x IS NOT NULL),
tp AS (SELECT factor, as_of, security_id FROM k WHERE i <= k), dt AS (SELECT factor, as_of, lag(as_of) OVER (PARTITION BY factor ORDER BY as_of) AS prev FROM (SELECT DISTINCT factor, as_of FROM tp)),
o AS (SELECT t.factor, t.as_of, 1 - count(p.security_id) / count(*)::DOUBLE AS t FROM tp t JOIN dt USING (factor, as_of) LEFT JOIN tp p ON p.factor = t.factor AND p.as_of = dt.prev AND p.security_id = t.security_id WHERE dt.prev IS NOT NULL GROUP BY 1, 2)
SELECT factor, round(avg(t), 6) AS turnover FROM o GROUP BY 1""")
def factor_turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.factor_turnover(_long(spark, d)))


@query(_LONG + f""", ch AS (SELECT security_id, as_of, adv_21d AS y FROM pn WHERE adv_21d IS NOT NULL), j AS (SELECT lg.*, ch.y FROM lg JOIN ch USING (security_id, as_of) WHERE x IS NOT NULL AND factor <> 'adv_21d'),
rk AS (SELECT *, {_ar('x', 'factor, as_of')} AS a, {_ar('y', 'factor, as_of')} AS b FROM j), ic AS (SELECT factor, as_of, corr(a, b) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT factor, 'adv_21d' AS characteristic, round(avg(CASE WHEN NOT isnan(ic) THEN ic END), 6) AS exposure FROM ic GROUP BY 1""")
def exposures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.exposures(_panel(spark, d), ["momentum_21d", "volatility_20d"], ["adv_21d"]))


@query(_LONG + " SELECT factor, round(count(x) / count(*)::DOUBLE, 6) AS coverage FROM lg GROUP BY 1")
def factor_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factors.coverage(_long(spark, d)))


_RET = V.with_sql(V.BENCH, V.SECURITIES) + f""",
r9 AS (SELECT security_id AS strategy, observation_date AS as_of, close / lag(close) OVER ({_W}) - 1 AS r FROM px),
b9 AS (SELECT observation_date AS as_of, close / lag(close) OVER (ORDER BY observation_date) - 1 AS b FROM bm), ret AS (SELECT r9.*, b9.b FROM r9 JOIN b9 USING (as_of) WHERE r IS NOT NULL AND b IS NOT NULL)"""


def _returns(spark: SparkSession, d: str) -> DataFrame:
    """Simple returns of all single names as strategies, with the benchmark's."""
    w = Window.partitionBy("security_id").orderBy("observation_date")
    p = V.prices(spark, d).select(F.col("security_id").alias("strategy"), F.col("observation_date").alias("as_of"), (F.col("close") / F.lag("close").over(w) - 1).alias("net_return"))
    b = V.benchmark(spark, d).select(F.col("observation_date").alias("as_of"), (F.col("close") / F.lag("close").over(Window.orderBy("observation_date")) - 1).alias("benchmark_return"))
    return p.join(F.broadcast(b), "as_of").where("net_return IS NOT NULL AND benchmark_return IS NOT NULL")


@query(_RET + """, c AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY as_of)) AS v FROM ret), dd AS (SELECT strategy, min(v / greatest(p, 1) - 1) AS mdd FROM (SELECT *, max(v) OVER (PARTITION BY strategy ORDER BY as_of) AS p FROM c) GROUP BY 1),
q AS (SELECT strategy, quantile_cont(r, 0.05) AS v5 FROM ret GROUP BY 1), es AS (SELECT strategy, avg(r) AS es FROM ret JOIN q USING (strategy) WHERE r <= v5 GROUP BY 1)
SELECT strategy, count(r) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(252), 6) AS sortino, round(stddev_samp(r) * sqrt(252), 6) AS volatility,
 round(avg((r > 0)::INT::DOUBLE), 6) AS win_rate, round(sum(r) FILTER (WHERE r > 0) / sum(-r) FILTER (WHERE r < 0), 6) AS profit_factor, round(regr_slope(r, b), 6) AS beta, round(stddev_samp(r - b) * sqrt(252), 6) AS tracking_error,
 round(avg(r - b) / stddev_samp(r - b) * sqrt(252), 6) AS information_ratio, round(any_value(mdd), 6) AS max_drawdown, round(any_value(v5), 6) AS var_95, round(any_value(es), 6) AS expected_shortfall_95
FROM ret JOIN dd USING (strategy) JOIN q USING (strategy) JOIN es USING (strategy) GROUP BY 1""")
def portfolio_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.bundle(_returns(spark, d), ["strategy"])
    return rounded(m.select("strategy", "n", "sharpe", "sortino", "volatility", "win_rate", "profit_factor", "beta", "tracking_error", "information_ratio", "max_drawdown", "var_95", "expected_shortfall_95"))


_MOM = _RET + """, mm AS (SELECT strategy, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM ret GROUP BY 1),
mo AS (SELECT strategy, any_value(n) AS n, any_value(m) AS m, any_value(sd) AS sd, avg(((r - m) / sd) ** 3) AS skew, avg(((r - m) / sd) ** 4) AS kurt FROM ret JOIN mm USING (strategy) GROUP BY 1)"""


@query(_MOM + " SELECT strategy, n, round(m / sd, 6) AS sharpe, round(skew, 5) AS skew, round(kurt, 4) AS kurtosis FROM mo")
def psr_inputs(spark: SparkSession, d: str) -> DataFrame:
    m = overfit.moments(_returns(spark, d))
    return m.select("strategy", "n", F.round("sharpe", 6).alias("sharpe"), F.round("skew", 5).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"))


@query()
def sharpe_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios and the minimum track record of each series."""
    m = overfit.minimum_track_record(overfit.deflated_sharpe(overfit.probabilistic_sharpe(overfit.moments(_returns(spark, d)))))
    return rounded(m)


_PBO_T = """, t AS (SELECT strategy, r, dense_rank() OVER (ORDER BY as_of) - 1 AS t FROM ret),
n AS (SELECT max(t) + 1 AS n, min(t) AS a FROM t), bk AS (SELECT strategy, least(floor((t - a) * 8 / n), 7)::INT AS b, count(r) AS c, sum(r) AS s, sum(r * r) AS q FROM t, n GROUP BY 1, 2),
cb AS (SELECT i AS split FROM range(0, 256) x(i) WHERE bit_count(i::INT) = 4),
m AS (SELECT split, (split::INT >> b) & 1 AS inside, strategy, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM bk, cb GROUP BY 1, 2, 3),
sr AS (SELECT *, CASE WHEN c > 1 AND (q - s * s / c) / (c - 1) > 1e-20 THEN s / c / sqrt((q - s * s / c) / (c - 1)) ELSE 0 END AS sr FROM m),
be AS (SELECT split, arg_max(strategy, (sr, strategy)) AS best FROM sr WHERE inside = 1 GROUP BY 1),
rk AS (SELECT sr.split, strategy, (rank() OVER (PARTITION BY split ORDER BY sr) + (count(*) OVER (PARTITION BY split, sr) - 1) / 2.0) / (count(*) OVER (PARTITION BY split) + 1) AS o FROM sr WHERE inside = 0)"""


@query(_RET + _PBO_T + " SELECT count(*) AS n_splits, round(avg((o <= 0.5)::INT::DOUBLE), 6) AS pbo FROM rk JOIN be ON be.split = rk.split AND be.best = rk.strategy")
def pbo(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d)
    days = r.select("as_of").distinct().withColumn("t", F.row_number().over(Window.orderBy("as_of")) - 1)
    return rounded(overfit.pbo(written(r.join(F.broadcast(days), "as_of"), "returns")))


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Block bootstrap of the benchmark's Sharpe ratio, seeded."""
    b = V.benchmark(spark, d).select(F.col("observation_date").alias("t"), (F.col("close") / F.lag("close").over(Window.orderBy("observation_date")) - 1).alias("net_return"))
    return rounded(overfit.bootstrap_sharpe(b, replicates=200))


@query(_RET + """, h AS (SELECT *, ntile(2) OVER (PARTITION BY strategy ORDER BY as_of) AS h FROM ret)
SELECT strategy, round(avg(r) FILTER (WHERE h = 1) / stddev_samp(r) FILTER (WHERE h = 1) * sqrt(252), 6) AS first_half_sharpe, round(avg(r) FILTER (WHERE h = 2) / stddev_samp(r) FILTER (WHERE h = 2) * sqrt(252), 6) AS second_half_sharpe FROM h GROUP BY 1""")
def half_sample_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(overfit.halves(_returns(spark, d)))


_COV = V.with_sql(V.BENCH) + f""",
k AS (SELECT security_id, observation_date AS d, close / lag(close) OVER ({_W}) - 1 AS r FROM px WHERE observation_date <= DATE '2000-06-30'),
w AS (SELECT * FROM k WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY d DESC) <= 120),
u AS (SELECT * FROM w WHERE security_id IN (SELECT security_id FROM w GROUP BY 1 HAVING count(*) >= 60)),
gr AS (SELECT i.security_id, t.d, coalesce(u.r, 0) AS r FROM (SELECT DISTINCT security_id FROM u) i CROSS JOIN (SELECT DISTINCT d FROM u) t LEFT JOIN u ON u.security_id = i.security_id AND u.d = t.d),
cv AS (SELECT a.security_id AS id_i, b.security_id AS id_j, covar_samp(a.r, b.r) * 252 AS cov FROM gr a JOIN gr b USING (d) GROUP BY 1, 2)"""


def _window(spark: SparkSession, d: str) -> DataFrame:
    return risk.trailing_returns(V.prices(spark, d), AS_OF, 120)


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    return written(_window(spark, d), "trailing")


@query(_COV + " SELECT id_i, id_j, round(cov, 6) AS cov FROM cv")
def pairwise_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled trailing covariance of all names that traded often enough up to the date; pairs grow with the square of the names."""
    return risk.covariance(_window(spark, d)).withColumn("cov", nearest(F.col("cov")))


@query(_COV + """, ew AS (SELECT DISTINCT id_i AS id, 1.0 / (SELECT count(DISTINCT id_i) FROM cv) AS w FROM cv), sw AS (SELECT id_i, sum(cov * w) AS s FROM cv JOIN ew ON id = id_j GROUP BY 1), v AS (SELECT sum(w * s) AS v FROM sw JOIN ew ON id = id_i)
SELECT id_i AS security_id, round(w::DOUBLE, 6) AS weight, round(s / sqrt(v), 6) AS marginal, round(w * s / sqrt(v), 6) AS contribution, round(w * s / v, 6) AS share FROM sw JOIN ew ON id = id_i, v""")
def risk_contribution(spark: SparkSession, d: str) -> DataFrame:
    kept = risk.screened(_window(spark, d))
    ids = kept.select("security_id").distinct()
    n = ids.agg(F.count("*").alias("n"))
    return rounded(risk.return_contributions(ids.crossJoin(n).select("security_id", (1 / F.col("n")).alias("weight")), kept))


@query(_COV + """, dn AS (SELECT count(DISTINCT d) AS n FROM u), mn AS (SELECT security_id, sum(r) / (SELECT n FROM dn) AS m FROM u GROUP BY 1), mq AS (SELECT sum(m * m) AS mm FROM mn),
nr AS (SELECT d, sum(r * r - 2 * r * m) AS q FROM u JOIN mn USING (security_id) GROUP BY 1), f4 AS (SELECT sum((q + mm) ** 2) AS f FROM nr, mq),
sz AS (SELECT sqrt(count(*)) AS p, sum(CASE WHEN id_i = id_j THEN cov END) AS tr, sum(cov * cov) AS ss FROM cv),
ab AS (SELECT tr / p AS mu, p, n, f, ss / (252.0 * 252.0) * ((n - 1.0) / n) ** 2 AS s2, tr / 252.0 * (n - 1.0) / n / p AS m2 FROM sz, dn, f4),
ai AS (SELECT mu, CASE WHEN s2 - p * m2 * m2 > 0 THEN least(greatest((f / n - s2) / n / (s2 - p * m2 * m2), 0), 1) ELSE 1.0 END::DOUBLE AS a FROM ab)
SELECT id_i, id_j, round((1 - a) * cov + CASE WHEN id_i = id_j THEN a * mu ELSE 0 END, 6) AS cov, round(a, 6) AS intensity FROM cv, ai""")
def shrunk_covariance(spark: SparkSession, d: str) -> DataFrame:
    kept = risk.screened(_window(spark, d))
    blocks = risk.covariance_blocks(kept)
    out = risk.shrunk(risk.covariance_pairs(blocks), returns=kept, sums=risk.covariance_sums(blocks))
    return out.withColumns({c: nearest(F.col(c)) for c in ("cov", "intensity")})


@query(_COV + """, bb AS (SELECT observation_date AS d, close / lag(close) OVER (ORDER BY observation_date) - 1 AS b FROM bm), x AS (SELECT security_id, count(r) AS n, regr_slope(r, b) AS s FROM w JOIN bb USING (d) WHERE b IS NOT NULL GROUP BY 1)
SELECT i.security_id, round(coalesce(CASE WHEN n >= 60 THEN least(greatest(s, -3), 5) END, 1), 6) AS beta FROM (SELECT DISTINCT security_id FROM w) i LEFT JOIN x USING (security_id)""")
def betas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.betas(_trailing(spark, d), V.benchmark(spark, d)))


_FAM = {"momentum": {"momentum_21d": 1}, "risk": {"volatility_20d": -1}, "liquidity": {"adv_21d": 1}}
_SCORE = _FEAT + """, lg AS (SELECT security_id, as_of, unnest(['momentum', 'risk', 'liquidity']) AS family, unnest([momentum_21d, volatility_20d, adv_21d]) AS x FROM fx), sg AS (SELECT *, CASE WHEN family = 'risk' THEN -1 ELSE 1 END AS sign FROM lg WHERE x IS NOT NULL)"""


@query(_SCORE + """, p AS (SELECT *, (rank() OVER (PARTITION BY as_of, family ORDER BY x) - 1) / count(*) OVER (PARTITION BY as_of, family)::DOUBLE * 100 AS p FROM sg)
SELECT security_id, as_of, family, round(CASE WHEN sign = 1 THEN p ELSE 100 - p END, 6) AS score, CASE WHEN (CASE WHEN sign = 1 THEN p ELSE 100 - p END) >= 80 THEN 'very strong' WHEN (CASE WHEN sign = 1 THEN p ELSE 100 - p END) >= 60 THEN 'strong'
 WHEN (CASE WHEN sign = 1 THEN p ELSE 100 - p END) >= 40 THEN 'average' WHEN (CASE WHEN sign = 1 THEN p ELSE 100 - p END) >= 20 THEN 'weak' ELSE 'very weak' END AS label FROM p""")
def peer_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Family scores of every name at each month end."""
    s = scorecard.family_scores(scorecard.scored(feature_panel(spark, d), _FAM))
    return rounded(s.select("security_id", "as_of", "family", "score", "label"))


@query(_SCORE + """, r AS (SELECT *, coalesce((row_number() OVER (PARTITION BY as_of, family ORDER BY x * sign, security_id DESC) - 1) / nullif(count(*) OVER (PARTITION BY as_of, family) - 1, 0)::DOUBLE, 0.5) AS r FROM sg),
c AS (SELECT security_id, as_of, sum(round(r * 1e9)::BIGINT) / count(*)::DOUBLE / 1e9 AS c FROM r GROUP BY 1, 2) SELECT security_id, as_of, round(c, 6) AS composite FROM c""")
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    c = scorecard.composite(scorecard.scored(feature_panel(spark, d), _FAM))
    return rounded(c.select("security_id", "as_of", "composite"))


@query(V.with_sql() + """, h AS (SELECT security_id, observation_date, close FROM px WHERE observation_date < DATE '2001-06-01'), l AS (SELECT security_id, max(observation_date) AS l FROM h GROUP BY 1),
q AS (SELECT security_id, observation_date, close AS price FROM px WHERE observation_date BETWEEN DATE '2001-05-01' AND DATE '2001-06-30')
SELECT security_id, observation_date, round(close + 1e-8, 6) AS close, false AS is_provisional FROM h
UNION ALL SELECT q.security_id, q.observation_date, round(price + 1e-8, 6), true FROM q JOIN l USING (security_id) WHERE q.observation_date > l.l""")
def provisional_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars up to May 2001 with later quotes as provisional ones."""
    p = V.prices(spark, d).select("security_id", "observation_date", "close", "adjusted_close", "volume")
    q = p.where("observation_date BETWEEN date'2001-05-01' AND date'2001-06-30'").select(F.col("security_id").alias("ticker"), F.col("close").alias("price"), F.col("observation_date").alias("session_date"), F.col("observation_date").cast("timestamp").alias("fetched_at"))
    out = scorecard.provisional_bars(p.where("observation_date < date'2001-06-01'"), q)
    return out.select("security_id", "observation_date", F.round(F.col("close") + 1e-8, 6).alias("close"), "is_provisional")


_COMP = _FEAT + f""", z AS (SELECT security_id, as_of, ({_ar('momentum_21d', 'as_of')} - 0.5) / count(*) OVER (PARTITION BY as_of) - 0.5 AS m, volatility_20d AS v FROM fx WHERE momentum_21d IS NOT NULL AND volatility_20d IS NOT NULL),
y AS (SELECT *, ({_ar('v', 'as_of')} - 0.5) / count(*) OVER (PARTITION BY as_of) - 0.5 AS vr FROM z), s AS (SELECT security_id, as_of, m * 0.6 - vr * 0.4 AS p FROM y)"""


@query(_COMP + " SELECT security_id, as_of, round(p, 6) AS prediction FROM s")
def factor_composite_score(spark: SparkSession, d: str) -> DataFrame:
    f = feature_panel(spark, d).where("momentum_21d IS NOT NULL AND volatility_20d IS NOT NULL")
    f = preprocess.rank_normalize(f, ["momentum_21d", "volatility_20d"])
    pillars = {"momentum": (0.3, {"momentum_21d": 1}), "risk": (0.2, {"volatility_20d": -1}), "value": (0.5, {"earnings_yield": 1})}
    return rounded(models.factor_composite(f, pillars).select("security_id", "as_of", "prediction"))


def _rk(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY as_of ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY as_of, {x}) - 1) / 2.0 - 0.5) / count({x}) OVER (PARTITION BY as_of) - 0.5 END"


NET = (2e-3, 0.5)
_SOFT = "CASE WHEN {0} > l1 THEN {0} - l1 WHEN {0} < -l1 THEN {0} + l1 ELSE 0 END"
# ranks by date, the training moments of each fold, and sweeps of coordinate descent over its normal equations
_WALK = (
    _LABELS + ", " + _FEAT[len(V.with_sql(V.BENCH, V.MONTH_ENDS, V.SECURITIES)) + 1 :].replace("FROM q1 WHERE as_of IN (SELECT as_of FROM me)", "FROM q1 WHERE as_of IN (SELECT max(observation_date) FROM li GROUP BY date_trunc('month', observation_date))")
    + f""", {V.SESSIONS}, {_FOLDS},
rn AS MATERIALIZED (SELECT security_id, as_of, window_end, excess_return AS y, {_rk('momentum_21d')} AS x1, {_rk('volatility_20d')} AS x2, {_rk('adv_21d')} AS x3 FROM fx JOIN l2 USING (security_id, as_of)),
em AS (SELECT fold::INT AS fold, a, v0, t0, t1, (SELECT c2.session FROM cal c1, cal c2 WHERE c1.session >= v0 AND c2.idx = c1.idx - 5 ORDER BY c1.session LIMIT 1) AS edge FROM fd),
mo AS MATERIALIZED (SELECT fold, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, covar_pop(x1, x1) AS g11, covar_pop(x2, x2) AS g22, covar_pop(x3, x3) AS g33, covar_pop(x1, x2) AS g12,
    covar_pop(x1, x3) AS g13, covar_pop(x2, x3) AS g23, covar_pop(x1, y) AS b1, covar_pop(x2, y) AS b2, covar_pop(x3, y) AS b3, {NET[0] * NET[1]} AS l1, {NET[0] * (1 - NET[1])} AS l2
  FROM rn JOIN em ON as_of >= a AND as_of < edge AND as_of < v0 AND window_end < v0 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL GROUP BY fold),
ms AS MATERIALIZED (SELECT mo.*, sc.* FROM mo, (VALUES ('full', 1, 1, 1), ('without_momentum_21d', 0, 1, 1), ('without_volatility_20d', 1, 0, 1), ('without_adv_21d', 1, 1, 0)) sc(scenario, k1, k2, k3)),
cd(fold, scenario, k, w1, w2, w3) AS (SELECT fold, scenario, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ms UNION ALL
  SELECT fold, scenario, k + 1, w1, w2, k3 * (""" + _SOFT.format("z") + """) / (g33 + l2) FROM (SELECT *, b3 - g13 * w1 - g23 * w2 AS z FROM (
    SELECT * EXCLUDE (w2, z), k2 * (""" + _SOFT.format("z") + """) / (g22 + l2) AS w2 FROM (SELECT *, b2 - g12 * w1 - g23 * w3 AS z FROM (
      SELECT * EXCLUDE (w1, z), k1 * (""" + _SOFT.format("z") + """) / (g11 + l2) AS w1 FROM (SELECT cd.*, ms.* EXCLUDE (fold, scenario), b1 - g12 * w2 - g13 * w3 AS z FROM cd JOIN ms USING (fold, scenario) WHERE k < 400)))))),
ca AS (SELECT cd.*, ms.* EXCLUDE (fold, scenario), my - w1 * m1 - w2 * m2 - w3 * m3 AS c FROM cd JOIN ms USING (fold, scenario) WHERE k = 400),
cf AS (SELECT * FROM ca WHERE scenario = 'full')"""
).replace("WITH li AS", "WITH RECURSIVE li AS", 1)
_WALKED = _WALK + f""", te AS (SELECT ca.fold, scenario, rn.as_of, y, c + w1 * coalesce(x1, 0) + w2 * coalesce(x2, 0) + w3 * coalesce(x3, 0) AS p FROM rn JOIN em ON as_of >= t0 AND as_of < t1 JOIN ca ON ca.fold = em.fold),
ti AS (SELECT fold, scenario, as_of, count(*) AS n, corr(a, b) AS ic FROM (SELECT *, {_ar('p', 'fold, scenario, as_of')} AS a, {_ar('y', 'fold, scenario, as_of')} AS b FROM te) GROUP BY 1, 2, 3),
vc AS (SELECT fold, scenario, ic FROM ti WHERE n >= 5 AND ic IS NOT NULL AND NOT isnan(ic)), v AS (SELECT * FROM vc WHERE scenario = 'full')"""


def _walk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Coefficients and predictions of elastic nets on ranked features over all folds, with purge and embargo."""
    p = preprocess.rank_normalize(_panel(spark, d), FACTORS)
    return walkforward.walk_forward(p, FACTORS, "excess_return", _schedule(spark), V.sessions(spark, d), 5, alpha=NET[0], l1_ratio=NET[1])


@query(_WALKED + """ SELECT fold, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std, round(avg((ic > 1e-12)::INT::DOUBLE), 6) AS share_positive, count(*) AS periods,
 round(avg(ic) / stddev_samp(ic), 6) AS ic_ir FROM v GROUP BY fold""")
def walk_forward_elastic_net(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample rank IC by fold, over all folds of the schedule, of an elastic net on ranked features, with purge and embargo."""
    _, scores = _walk(spark, d)
    return rounded(metrics.ic_summary(metrics.ic_by_date(scores.where("split = 'test'"), "prediction", "excess_return", ["fold"]), ["fold"]))


@query(_WALK + """ SELECT fold, n AS n_train, round(c, 6) AS intercept, unnest(['momentum_21d', 'volatility_20d', 'adv_21d']) AS feature, round(unnest([w1, w2, w3]), 6) AS coefficient FROM cf""")
def walk_forward_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Training rows, intercept and coefficients of every fold."""
    return rounded(_walk(spark, d)[0])


@query(_WALK + """, lc AS (SELECT fold, unnest(['momentum_21d', 'volatility_20d', 'adv_21d']) AS feature, unnest([w1, w2, w3]) AS c FROM cf)
SELECT feature, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS sd, round(abs(sum(sign(c))) / count(c), 6) AS sign_consistency, round(avg((abs(c) > 1e-12)::INT::DOUBLE), 6) AS share_nonzero FROM lc GROUP BY 1""")
def coefficient_stability(spark: SparkSession, d: str) -> DataFrame:
    """How steady the coefficients of the folds are."""
    return rounded(models.coefficient_stability(_walk(spark, d)[0]))


@query(_WALKED + """ SELECT CASE WHEN scenario = 'full' THEN 'baseline' ELSE 'ablation' END AS category, scenario, fold, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std,
 round(avg((ic > 1e-12)::INT::DOUBLE), 6) AS share_positive, count(*) AS periods, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir FROM vc GROUP BY fold, scenario""")
def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    """What each fold's rank IC is with all factors and without each of them, from one pass over the panel."""
    p = preprocess.rank_normalize(_panel(spark, d), FACTORS)
    return rounded(ablation.stressed(p, FACTORS, "excess_return", _schedule(spark), {f: [f] for f in FACTORS}, (), V.sessions(spark, d), 5, alpha=NET[0], l1_ratio=NET[1]))


@query()
def placebo_stress(spark: SparkSession, d: str) -> DataFrame:
    """Ablations and targets dealt anew within their dates, over all folds: what each scenario gives up."""
    p = preprocess.rank_normalize(_panel(spark, d), FACTORS)
    return rounded(ablation.stress_rows(ablation.stressed(p, FACTORS, "excess_return", _schedule(spark), {f: [f] for f in FACTORS}, (1, 2, 3), V.sessions(spark, d), 5, alpha=NET[0], l1_ratio=NET[1])))


@query(_PANEL + """, t AS (SELECT avg(excess_return) AS m FROM pn WHERE as_of < DATE '1998-06-30') SELECT security_id, as_of, round(m, 6) AS prediction FROM pn, t WHERE as_of >= DATE '1998-06-30'""")
def no_skill_baseline(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    cut = F.lit(date(1998, 6, 30))
    return rounded(models.no_skill(p.where(F.col("as_of") < cut), p.where(F.col("as_of") >= cut), "excess_return").select("security_id", "as_of", "prediction"))


@query()
def placebo_ic(spark: SparkSession, d: str) -> DataFrame:
    """Mean IC of momentum ranks dealt anew within each date: near zero."""
    p = stress.shuffled(_panel(spark, d).select("security_id", "as_of", "momentum_21d", "excess_return"), "momentum_21d", 11)
    return rounded(metrics.ic_summary(metrics.ic_by_date(p, "momentum_21d", "excess_return")))


@query(_PANEL + """, c AS (SELECT security_id, as_of, raw_return / count(*) OVER (PARTITION BY as_of) AS c FROM pn), s AS (SELECT security_id, abs(sum(c)) AS c FROM c GROUP BY 1), y AS (SELECT year(as_of) AS y, abs(sum(c)) AS c FROM c GROUP BY 1),
e AS (SELECT coalesce(sector, 'unknown') AS e, abs(sum(c)) AS c FROM c LEFT JOIN sec USING (security_id) GROUP BY 1)
SELECT round((SELECT sum(c) FROM (SELECT c FROM s ORDER BY c DESC LIMIT 5)) / (SELECT sum(c) FROM s), 6) AS top5_securities, round((SELECT max(c) FROM e) / (SELECT sum(c) FROM e), 6) AS top_sector, round((SELECT max(c) FROM y) / (SELECT sum(c) FROM y), 6) AS top_year""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    w = p.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("as_of"))).select("as_of", "security_id", "weight")
    out = stress.concentration(stress.contributions(w, p.select("as_of", "security_id", "raw_return")), written(V.securities(spark, d), "securities"))
    return rounded(out.select("top5_securities", "top_sector", "top_year"))


@query(_RET + """, m AS (SELECT strategy, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, count(r)::DOUBLE AS n FROM ret GROUP BY 1)
SELECT strategy, (sharpe < 0)::INT + (n < 500)::INT AS n_failed, CASE WHEN sharpe >= 0 AND n >= 500 THEN 'accepted' ELSE 'rejected' END AS status FROM m""")
def acceptance_gates(spark: SparkSession, d: str) -> DataFrame:
    long = metrics.long_metrics(metrics.bundle(_returns(spark, d), ["strategy"]), ["strategy"])
    t = spark.createDataFrame([("return", "sharpe", "min", 0.0), ("length", "n", "min", 500.0)], "gate string, metric string, direction string, threshold double")
    out = stress.acceptance(stress.gates(long, t))
    return out.select("strategy", F.col("n_failed").cast("int").alias("n_failed"), "status")


@query(_IC + " SELECT factor, as_of, n FROM ic WHERE factor = 'momentum_21d' ORDER BY as_of, factor LIMIT 20 OFFSET 10")
def results_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a results table in a fixed order."""
    df, _ = results.page(factors.ic_series(_long(spark, d), "excess_return").select("factor", "as_of", "n"), ["as_of", "factor"], 20, 10, factor="momentum_21d")
    return df


@query(_RET + " SELECT count(*) AS n, min(as_of) AS first_date, max(as_of) AS last_date FROM ret")
def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    """Row count and date range of a table as a snapshot records them (its digest is tested elsewhere)."""
    r = _returns(spark, d)
    return writers.digest(r).select("n").crossJoin(writers.date_range(r))


@query(_PANEL + f""", a AS (SELECT security_id, as_of, {_ar('momentum_21d', 'as_of')} / count(momentum_21d) OVER (PARTITION BY as_of) AS r1, {_ar('-volatility_20d', 'as_of')} / count(volatility_20d) OVER (PARTITION BY as_of) AS r2 FROM pn WHERE momentum_21d IS NOT NULL AND volatility_20d IS NOT NULL)
SELECT security_id, as_of, round(0.7 * r1 + 0.3 * r2, 6) AS prediction FROM a""")
def ensemble_blend(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d).where("momentum_21d IS NOT NULL AND volatility_20d IS NOT NULL")
    a = models.single_column(p, "momentum_21d").withColumn("model", F.lit("a"))
    b = models.single_column(p.withColumn("v", -F.col("volatility_20d")), "v").withColumn("model", F.lit("b"))
    return rounded(models.ensemble_score(a.unionByName(b), {"a": 0.7, "b": 0.3}).select("security_id", "as_of", "prediction"))


@query(_IC + """, q AS (SELECT factor, mean_return, bucket, (rank() OVER (PARTITION BY factor ORDER BY mean_return) + 0.0) AS r FROM (SELECT factor, bucket, avg(m) AS mean_return FROM (SELECT factor, as_of, bucket, avg(excess_return) AS m FROM (
  SELECT *, floor((row_number() OVER (PARTITION BY factor, as_of ORDER BY x, security_id) - 1) * 5 / count(*) OVER (PARTITION BY factor, as_of))::INT AS bucket FROM lg WHERE x IS NOT NULL) GROUP BY ALL) GROUP BY 1, 2))
SELECT factor, round(corr(bucket, r), 6) AS monotonicity, round(max(mean_return) FILTER (WHERE bucket = 4) - max(mean_return) FILTER (WHERE bucket = 0), 6) AS spread FROM q GROUP BY 1""")
def factor_report(spark: SparkSession, d: str) -> DataFrame:
    out = factors.factor_report(_panel(spark, d), FACTORS, "excess_return")
    return rounded(out.select("factor", "monotonicity", "spread"))

