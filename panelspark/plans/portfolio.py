"""Queries over weights, costs, trades and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import average_rank
from panelspark.operators import accounts, calendar, grid, ledger, risk, trades, weights
from panelspark.plans import views as V
from panelspark.plans.features import rounded
from panelspark.plans.research import _ar
from panelspark.plans.states import _FEAT, feature_panel
from panelspark.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CAND = _FEAT + f""", cd AS (SELECT security_id, as_of, volatility_20d AS v, {_ar('momentum_21d', 'as_of')} / count(*) OVER (PARTITION BY as_of) AS k FROM fx WHERE momentum_21d IS NOT NULL),
tp AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY k DESC, security_id) <= 10)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    f = feature_panel(spark, d).where("momentum_21d IS NOT NULL")
    n = F.count("*").over(Window.partitionBy("as_of"))
    return f.select("security_id", "as_of", F.col("volatility_20d").alias("volatility_60d"), (average_rank(F.col("momentum_21d"), "as_of") / n).alias("cross_sectional_rank"))


def _capped(score: str, cap: float) -> str:
    """The definition by rounds: what is over the cap is handed on until nothing is (as many rounds as names)."""
    rounds = [f", c0 AS (SELECT security_id, as_of, {score} AS s, false AS done FROM tp)"]
    for i in range(11):
        rounds.append(f""", d{i} AS (SELECT *, CASE WHEN done THEN {cap} ELSE greatest(s * (1 - coalesce(sum({cap}) FILTER (WHERE done) OVER (PARTITION BY as_of), 0)) / sum(s) FILTER (WHERE NOT done) OVER (PARTITION BY as_of), 0) END AS w FROM c{i}),
c{i + 1} AS (SELECT security_id, as_of, s, done OR w > {cap} + 1e-12 AS done FROM d{i})""")
    return "".join(rounds) + f", fin AS (SELECT security_id, as_of, least(w, {cap}) AS w FROM d10)"


@query(_CAND + " SELECT as_of, security_id, round(least(1.0 / count(*) OVER (PARTITION BY as_of), 0.2)::DOUBLE, 6) AS weight FROM tp")
def equal_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.equal_weight(_candidates(spark, d), 10, 0.2))


@query(_CAND + _capped("k - min(k) OVER (PARTITION BY as_of) + 1e-6", 0.15) + " SELECT as_of, security_id, round(w, 6) AS weight FROM fin")
def score_weight_capped(spark: SparkSession, d: str) -> DataFrame:
    """Rank-proportional weights under a cap; the SQL repeats the redistribution, the query sorts once."""
    return rounded(weights.score_weight(_candidates(spark, d), 10, 0.15))


@query(_CAND + _capped("1 / coalesce(CASE WHEN v > 0 THEN v END, median(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY as_of), 1)", 0.12) + " SELECT as_of, security_id, round(w, 6) AS weight FROM fin")
def inverse_vol_capped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.inverse_volatility(_candidates(spark, d), 10, 0.12))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return weights.equal_weight(_candidates(spark, d), 10, 0.2)


_EW = _CAND + ", ew AS (SELECT as_of, security_id, least(1.0 / count(*) OVER (PARTITION BY as_of), 0.2)::DOUBLE AS weight FROM tp)"


@query(_EW + """ SELECT as_of, count(*) FILTER (WHERE weight > 1e-6) AS n_names, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest,
 (sum(weight) < 1 - 1e-3)::INT + (max(weight) > 0.15 + 1e-6)::INT AS n_violations FROM ew GROUP BY 1""")
def mandate_audit(spark: SparkSession, d: str) -> DataFrame:
    a = weights.audit(_weights(spark, d), 0.15, 0.0, 10)
    return rounded(a.select("as_of", "n_names", "total", "largest", F.size("violations").alias("n_violations")))


_PREV = _EW + """, dt AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nx FROM (SELECT DISTINCT as_of FROM ew)), pv AS (SELECT nx AS as_of, security_id, weight AS p FROM ew JOIN dt USING (as_of) WHERE nx IS NOT NULL),
mv AS (SELECT as_of, security_id, coalesce(weight, 0) AS w, coalesce(p, 0) AS p FROM ew FULL JOIN pv USING (as_of, security_id))"""


@query(_PREV + " SELECT as_of, round(sum(abs(w - p)) / 2, 6) AS turnover FROM mv GROUP BY 1")
def turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.turnover(_weights(spark, d)))


@query(_EW + " SELECT as_of, round(1 / sum((weight / t) ** 2), 6) AS effective_n, round(max(weight / t), 6) AS largest FROM (SELECT *, sum(weight) OVER (PARTITION BY as_of) AS t FROM ew) GROUP BY 1")
def herfindahl(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.concentration(_weights(spark, d)).select("as_of", "effective_n", "largest"))


_TRADES = _PREV + f""", {V.SESSIONS}, fd AS (SELECT mv.*, c2.session AS fill_date FROM mv JOIN cal c1 ON c1.session = mv.as_of JOIN cal c2 ON c2.idx = c1.idx + 1),
pf AS (SELECT fd.*, p.close FROM fd ASOF JOIN px p ON p.security_id = fd.security_id AND p.observation_date <= fd.fill_date),
lq AS (SELECT security_id, observation_date, CASE WHEN count(dollar_volume) OVER a >= 5 THEN avg(dollar_volume) OVER a END AS adv, CASE WHEN count(r) OVER b >= 20 THEN stddev_samp(r) OVER b * sqrt(252) END AS vol
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY observation_date) - 1 AS r FROM px)
  WINDOW a AS (PARTITION BY security_id ORDER BY observation_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), b AS (PARTITION BY security_id ORDER BY observation_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
tl AS (SELECT pf.*, lq.adv, lq.vol, (w - p) * 1e4 / close AS shares, abs((w - p) * 1e4) AS n FROM pf ASOF LEFT JOIN lq ON lq.security_id = pf.security_id AND lq.observation_date <= pf.as_of),
tc AS (SELECT *, n * 0.5 / 1e4 + n * 2.0 / 1e4 * CASE WHEN adv > 0 THEN least(greatest(sqrt(1e7 / adv), 0.5), 10) ELSE 3 END + n * 1.0 / 1e4
  + 0.1 * coalesce(vol, 0.3) / sqrt(252) * sqrt(CASE WHEN adv > 0 THEN n / adv ELSE 0.05 END) * n AS cost FROM tl WHERE n >= 1)"""


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return trades.trade_list(_weights(spark, d), V.prices(spark, d), V.sessions(spark, d), 1e4)


@query(_TRADES + """ SELECT s.cost_scenario, fill_date, count(*) AS n, count(*) FILTER (WHERE shares < 0) AS n_sells, round(sum(n), 2) AS notional, round(sum(cost * x), 2) AS total_cost
FROM tc, (VALUES ('zero', 0.0), ('base', 1.0), ('double', 2.0), ('triple', 3.0)) s(cost_scenario, x) GROUP BY 1, 2""")
def trade_costs_by_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Trades of a monthly equal-weight strategy in four cost scenarios, by fill date."""
    by = _trades(spark, d).groupBy("cost_scenario", "fill_date").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "sell").alias("n_sells"), F.sum("notional").alias("notional"), F.sum("total_cost").alias("total_cost"))
    return by.select("cost_scenario", "fill_date", "n", "n_sells", F.round("notional", 2).alias("notional"), F.round("total_cost", 2).alias("total_cost"))


_CURVE = _TRADES + """, hf AS (SELECT ew.security_id, ew.weight, c2.session AS f FROM ew JOIN cal c1 ON c1.session = ew.as_of JOIN cal c2 ON c2.idx = c1.idx + 1),
fe AS (SELECT f, lead(f) OVER (ORDER BY f) AS e FROM (SELECT DISTINCT f FROM hf)),
lv AS (SELECT security_id, weight, hf.f, e, session AS d FROM hf JOIN fe USING (f) JOIN cal ON session >= f AND (e IS NULL OR session <= e)),
lb AS (SELECT lv.*, px.close AS q FROM lv ASOF LEFT JOIN px ON px.security_id = lv.security_id AND px.observation_date <= lv.d),
l0 AS (SELECT *, first_value(q IGNORE NULLS) OVER (PARTITION BY security_id, f ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q0 FROM lb),
sg AS (SELECT f, e, d, sum(weight * coalesce(q / q0, 1)) + 1 - sum(weight) AS g FROM l0 GROUP BY 1, 2, 3), cs AS (SELECT fill_date AS f, sum(cost) / 1e4 AS c FROM tc GROUP BY 1),
s2 AS (SELECT sg.*, coalesce(c, 0) AS c FROM sg LEFT JOIN cs USING (f)), en AS (SELECT e AS f, ln(g) AS lg FROM s2 WHERE d = e),
sb AS (SELECT f, exp(sum(coalesce(lg, 0) + ln(greatest(1 - c, 1e-12))) OVER (ORDER BY f)) AS base FROM (SELECT DISTINCT f, c FROM s2) LEFT JOIN en USING (f))"""


@query(_CURVE + " SELECT d AS as_of, round(g, 6) AS segment_growth, round(c, 6) AS cost_fraction, round(base * g, 6) AS value FROM s2 JOIN sb USING (f) WHERE e IS NULL OR d < e")
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    """Net value of the same strategy, costs as a fraction of the value at the previous rebalance."""
    t = _trades(spark, d).where("cost_scenario = 'base'").groupBy("fill_date").agg((F.sum("total_cost") / 1e4).alias("cost_fraction"))
    c = trades.equity_curve(_weights(spark, d), V.prices(spark, d), V.sessions(spark, d), trade_costs=t)
    return rounded(c.select("as_of", "segment_growth", "cost_fraction", "value"))


_GRID = _CAND + _capped("k - min(k) OVER (PARTITION BY as_of) + 1e-6", 0.15) + f""",
sw AS (SELECT 'equal_10' AS strategy, as_of, security_id, least(1.0 / count(*) OVER (PARTITION BY as_of), 0.2)::DOUBLE AS weight FROM tp UNION ALL SELECT 'score_10', as_of, security_id, w FROM fin),
gd AS (SELECT strategy, as_of, lead(as_of) OVER (PARTITION BY strategy ORDER BY as_of) AS nx FROM (SELECT DISTINCT strategy, as_of FROM sw)),
gp AS (SELECT strategy, nx AS as_of, security_id, weight AS p FROM sw JOIN gd USING (strategy, as_of) WHERE nx IS NOT NULL),
gm AS (SELECT strategy, as_of, security_id, coalesce(weight, 0) AS w, coalesce(p, 0) AS p FROM sw FULL JOIN gp USING (strategy, as_of, security_id)),
{V.SESSIONS}, gf AS (SELECT gm.*, delay, c2.session AS f FROM gm JOIN cal c1 ON c1.session = gm.as_of, (VALUES (1), (2), (5)) dl(delay) JOIN cal c2 ON c2.idx = c1.idx + delay),
gq AS (SELECT gf.*, px.close FROM gf ASOF LEFT JOIN px ON px.security_id = gf.security_id AND px.observation_date <= gf.f),
lq AS (SELECT security_id, observation_date, CASE WHEN count(dollar_volume) OVER a >= 5 THEN avg(dollar_volume) OVER a END AS adv, CASE WHEN count(r) OVER b >= 20 THEN stddev_samp(r) OVER b * sqrt(252) END AS vol
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY observation_date) - 1 AS r FROM px)
  WINDOW a AS (PARTITION BY security_id ORDER BY observation_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), b AS (PARTITION BY security_id ORDER BY observation_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
gt AS (SELECT gq.*, lq.adv, lq.vol, abs((w - p) * 1e4) AS n FROM gq ASOF LEFT JOIN lq ON lq.security_id = gq.security_id AND lq.observation_date <= gq.as_of WHERE gq.close > 0),
gc AS (SELECT strategy, delay, f, s.cost_scenario, count(*) AS n, sum(x * (n * 0.5 / 1e4 + n * 2.0 / 1e4 * CASE WHEN adv > 0 THEN least(greatest(sqrt(1e7 / adv), 0.5), 10) ELSE 3 END + n * 1.0 / 1e4
  + 0.1 * coalesce(vol, 0.3) / sqrt(252) * sqrt(CASE WHEN adv > 0 THEN n / adv ELSE 0.05 END) * n)) / 1e4 AS c
  FROM gt, (VALUES ('zero', 0.0), ('base', 1.0), ('double', 2.0), ('triple', 3.0)) s(cost_scenario, x) WHERE n >= 1 GROUP BY 1, 2, 3, 4),
ge AS (SELECT strategy, delay, f, lead(f) OVER (PARTITION BY strategy, delay ORDER BY f) AS e FROM (SELECT DISTINCT strategy, delay, f FROM gf)),
gh AS (SELECT gq.*, ge.e FROM gq JOIN ge USING (strategy, delay, f) WHERE w > 0 AND e IS NOT NULL),
gg AS (SELECT strategy, delay, f, sum(w * coalesce(q / close, 1)) + 1 - sum(w) AS g FROM (SELECT gh.*, p2.close AS q FROM gh ASOF LEFT JOIN px p2 ON p2.security_id = gh.security_id AND p2.observation_date <= gh.e) GROUP BY 1, 2, 3),
grid AS (SELECT strategy, delay::INT AS delay, sc.cost_scenario, count(*) AS n_rebalances, coalesce(sum(n), 0)::BIGINT AS n_trades, round(sum(coalesce(c, 0)), 6) AS cost_fraction, round(min(coalesce(g, 1)) - 1, 6) AS worst_segment,
  round(sum(ln(coalesce(g, 1)) + ln(greatest(1 - coalesce(c, 0), 1e-12))), 6) AS log_growth
  FROM ge CROSS JOIN (SELECT DISTINCT cost_scenario FROM gc) sc LEFT JOIN gc USING (strategy, delay, f, cost_scenario) LEFT JOIN gg USING (strategy, delay, f) GROUP BY 1, 2, 3)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    c = written(_candidates(spark, d), "candidates")
    both = {"equal_10": weights.equal_weight(c, 10, 0.2), "score_10": weights.score_weight(c, 10, 0.15)}
    w = None
    for name, df in both.items():
        one = df.select(F.lit(name).alias("strategy"), "as_of", "security_id", "weight")
        w = one if w is None else w.unionByName(one)
    return grid.scenario_grid(written(w, "weights"), written(V.prices(spark, d), "prices"), V.sessions(spark, d), 1e4, (1, 2, 5))


@query(_GRID + " SELECT * FROM grid")
def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two constructors under three delays and four cost scenarios."""
    return rounded(_grid(spark, d))


@query(_GRID + """ SELECT CASE WHEN strategy <> 'equal_10' THEN 'portfolio:' || strategy WHEN delay <> 1 THEN 'delay:' || delay WHEN cost_scenario <> 'base' THEN 'cost:' || cost_scenario ELSE 'base' END AS "case", * FROM grid
WHERE (strategy <> 'equal_10')::INT + (delay <> 1)::INT + (cost_scenario <> 'base')::INT <= 1""")
def stress_cases(spark: SparkSession, d: str) -> DataFrame:
    """The grid's cells one step away from equal weights, one session of delay and base costs."""
    return rounded(grid.stress_cases(_grid(spark, d), "equal_10"))


@query(V.with_sql(V.SECURITIES) + """ SELECT me.as_of, sector, round(count(*) / sum(count(*)) OVER (PARTITION BY me.as_of), 6)::DOUBLE AS weight FROM px JOIN (SELECT max(observation_date) AS as_of FROM li GROUP BY date_trunc('month', observation_date)) me ON px.observation_date = me.as_of JOIN sec USING (security_id) GROUP BY 1, 2""")
def universe_sector_weights(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).withColumnRenamed("observation_date", "as_of").join(F.broadcast(V.month_ends(spark, d)), "as_of").join(V.securities(spark, d).select("security_id", "sector"), "security_id")
    return rounded(weights.universe_sector_weights(p))


@query("WITH " + V.FILLS + """ SELECT account, security_id, sum(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END)::DOUBLE AS quantity, round(sum(CASE WHEN side = 'buy' THEN -cents ELSE cents END) / 100.0, 2) AS cash FROM fl GROUP BY 1, 2""")
def positions_from_fills(spark: SparkSession, d: str) -> DataFrame:
    p = ledger.balances(V.fills(spark, d).withColumn("cost", F.lit(0.0)))
    return p.select("account", "security_id", "quantity", F.round("cash", 2).alias("cash"))


@query("WITH RECURSIVE " + V.FILLS + """, o AS (SELECT *, row_number() OVER (PARTITION BY account, security_id ORDER BY ts, event_id) AS i FROM fl),
w AS (SELECT account, security_id, i, CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END::DOUBLE AS q, CASE WHEN side = 'buy' THEN cents / 100.0 ELSE 0 END::DOUBLE AS avg, CASE WHEN side = 'buy' THEN 0 ELSE 0 END::DOUBLE AS pnl FROM o WHERE i = 1
 UNION ALL SELECT o.account, o.security_id, o.i, w.q + CASE WHEN side = 'buy' THEN 1 ELSE -1 END,
  CASE WHEN side = 'buy' AND w.q + 1 > 0 THEN (w.q * w.avg + cents / 100.0) / (w.q + 1) WHEN w.q + CASE WHEN side = 'buy' THEN 1 ELSE -1 END > 0 THEN w.avg ELSE 0 END,
  w.pnl + CASE WHEN side = 'sell' THEN least(1, greatest(w.q, 0)) * (cents / 100.0 - w.avg) ELSE 0 END
  FROM w JOIN o ON o.account = w.account AND o.security_id = w.security_id AND o.i = w.i + 1)
SELECT account, security_id, round(arg_max(avg, i), 4) AS average_cost, round(arg_max(pnl, i), 4) AS realised FROM w GROUP BY 1, 2""")
def average_cost(spark: SparkSession, d: str) -> DataFrame:
    p = ledger.positions(V.fills(spark, d).withColumn("cost", F.lit(0.0)))
    return p.select("account", "security_id", F.round("average_cost", 4).alias("average_cost"), F.round("realised", 4).alias("realised"))


CAPITAL = 10_000.0
_PATHS = "WITH " + V.FILLS + f""", s AS (SELECT DISTINCT ts::DATE AS d FROM fl),
pr AS (SELECT security_id, ts::DATE AS d, cents / 100.0 AS p FROM fl QUALIFY row_number() OVER (PARTITION BY security_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1),
pg AS (SELECT x.security_id, s.d, last_value(p IGNORE NULLS) OVER (PARTITION BY x.security_id ORDER BY s.d) AS p FROM (SELECT DISTINCT security_id FROM fl) x CROSS JOIN s LEFT JOIN pr ON pr.security_id = x.security_id AND pr.d = s.d),
dq AS (SELECT account, security_id, ts::DATE AS d, sum(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) AS q FROM fl GROUP BY ALL),
aq AS (SELECT a.account, a.security_id, s.d, sum(coalesce(q, 0)) OVER (PARTITION BY a.account, a.security_id ORDER BY s.d) AS q FROM (SELECT DISTINCT account, security_id FROM fl) a CROSS JOIN s LEFT JOIN dq ON dq.account = a.account AND dq.security_id = a.security_id AND dq.d = s.d),
va AS (SELECT account, d, sum(q * p) FILTER (WHERE q <> 0) AS v, count(*) FILTER (WHERE q <> 0) AS n FROM aq JOIN pg USING (security_id, d) GROUP BY 1, 2),
dc AS (SELECT account, ts::DATE AS d, sum(CASE WHEN side = 'buy' THEN -cents ELSE cents END - 10) / 100.0 AS c, count(*) * 0.1 AS k FROM fl GROUP BY 1, 2),
ac AS (SELECT a.account, s.d, {CAPITAL} + sum(coalesce(c, 0)) OVER (PARTITION BY a.account ORDER BY s.d) AS cash, sum(coalesce(k, 0)) OVER (PARTITION BY a.account ORDER BY s.d) AS costs
  FROM (SELECT account, min(d) AS f FROM dc GROUP BY 1) a JOIN s ON s.d >= a.f LEFT JOIN dc ON dc.account = a.account AND dc.d = s.d),
eq AS (SELECT account, d, cash, costs, coalesce(v, 0) AS pv, coalesce(n, 0) AS n, cash + coalesce(v, 0) AS tv FROM ac LEFT JOIN va USING (account, d))"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that pay ten cents a fill, marked at the last fill of each security."""
    f = V.fills(spark, d).withColumn("cost", F.lit(0.1))
    bars = f.groupBy("security_id", F.to_date("ts").alias("observation_date")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("close"))
    cal = calendar.numbered(f.select(F.to_date("ts").alias("session")).distinct())
    return accounts.equity_paths(f, bars, cal, CAPITAL)


@query(_PATHS + " SELECT account, d AS as_of, round(tv, 4) AS total_value, round(cash, 4) AS cash, round(pv, 4) AS positions_value, n AS n_positions, round(costs, 4)::DOUBLE AS costs FROM eq")
def account_equity(spark: SparkSession, d: str) -> DataFrame:
    """Every account's value on every day from its first fill on."""
    e = _paths(spark, d)
    return e.select("account", "as_of", *[F.round(c, 4).alias(c) for c in ("total_value", "cash", "positions_value", "costs")], "n_positions")


@query(_PATHS + f""", rr AS (SELECT *, tv / lag(tv) OVER (PARTITION BY account ORDER BY d) - 1 AS r FROM eq),
cu AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY account ORDER BY d)) AS cv FROM rr WHERE r IS NOT NULL),
dd AS (SELECT account, min(cv / greatest(pk, 1) - 1) AS mdd FROM (SELECT *, max(cv) OVER (PARTITION BY account ORDER BY d) AS pk FROM cu) GROUP BY 1)
SELECT account, max(d) AS as_of, round(arg_max(tv, d), 4) AS total_value, round(arg_max(tv, d) / {CAPITAL} - 1, 6) AS total_return, count(r) AS n_observations,
 round(CASE WHEN count(r) >= 2 AND stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 4) AS sharpe, round(CASE WHEN count(r) >= 2 THEN any_value(mdd) END, 6) AS max_drawdown FROM rr LEFT JOIN dd USING (account) GROUP BY 1""")
def account_monitoring(spark: SparkSession, d: str) -> DataFrame:
    """Sharpe ratio, deepest fall and total return of each account's marks."""
    m = accounts.monitoring(_paths(spark, d), CAPITAL)
    return m.select("account", "as_of", F.round("total_value", 4).alias("total_value"), F.round("total_return", 6).alias("total_return"), "n_observations", F.round("sharpe", 4).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query("""WITH od AS (SELECT event_id AS order_id, round(value * 100)::BIGINT AS c FROM events WHERE event_type = 'purchase'), fi AS (SELECT event_id AS order_id, event_id % 4 AS g FROM events WHERE event_type = 'purchase' AND event_id % 4 > 0)
SELECT order_id, round(coalesce(g / 3.0, 0), 6)::DOUBLE AS fill_ratio, CASE WHEN g IS NULL THEN 'unfilled' WHEN g < 3 THEN 'partial' ELSE '' END AS warning FROM od LEFT JOIN fi USING (order_id)""")
def order_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Orders of three units, filled by id in none to three of them."""
    f = V.fills(spark, d)
    o = f.select(F.col("event_id").alias("order_id"), "side", F.lit(3.0).alias("quantity"), F.col("price").alias("reference_price"), F.lit(0.0).alias("expected_cost"))
    done = f.where("event_id % 4 > 0").select(F.col("event_id").alias("order_id"), (F.col("event_id") % 4).cast("double").alias("quantity"), "price", F.lit(0.0).alias("cost"))
    r = ledger.reconcile(o, done)
    return r.select("order_id", F.round("fill_ratio", 6).alias("fill_ratio"), F.array_join("warnings", ",").alias("warning"))


@query("""WITH l AS (SELECT event_id, event_id % 50 AS order_id, ts AS t, CASE WHEN event_type IN ('view', 'click') THEN 'approve' ELSE 'reject' END AS decision FROM events)
SELECT order_id, arg_max(decision, (t, event_id)) AS decision FROM l GROUP BY 1""")
def order_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("order_id"), F.col("ts").alias("at"), F.when(F.col("event_type").isin("view", "click"), "approve").otherwise("reject").alias("decision"))
    return ledger.decisions(e).select("order_id", "decision")

