"""Queries over company facts and whole fundamentals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import asof, facts, features_fund, scorecard
from panelspark.plans import views as V
from panelspark.plans.features import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = date(1999, 6, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def company_facts(spark: SparkSession, d: str) -> DataFrame:
    """Tagged facts (company, tag, unit, start, end, filed, value) of the derived filings; a third of the companies each use one revenue tag, the other, or both."""
    fu = V.fundamentals(spark, d)
    start = F.add_months(F.trunc("fiscal_period_end", "month"), -2)
    none = F.lit(None).cast("date")
    k = F.pmod("security_id", F.lit(3))

    def fact(tag: str, value, begins=start, when=F.lit(True)):
        return F.when(when, F.struct(F.lit(tag).alias("tag"), begins.alias("start"), value.alias("value")))

    new, old = "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"
    rows = F.array_compact(F.array(
        fact(new, F.col("revenue"), when=k != 1), fact(old, F.col("revenue") * 0.5, when=k != 0), fact("NetIncomeLoss", F.col("net_income")), fact("Assets", F.col("total_assets"), none)))
    out = fu.select(F.col("security_id").alias("company"), F.explode(rows).alias("f"), F.lit("USD").alias("unit"), F.col("fiscal_period_end").alias("end"), F.col("filing_date").alias("filed"))
    return out.select("company", "f.tag", "unit", "f.start", "end", "filed", "f.value")


_FACTS = V.with_sql(V.FUNDAMENTALS) + f""",
kn AS (SELECT security_id AS company, fiscal_period_end AS e, (date_trunc('month', fiscal_period_end) - INTERVAL 2 MONTH)::DATE AS s, filing_date, net_income, total_assets,
    CASE WHEN security_id % 3 = 1 THEN revenue * 0.5 ELSE revenue END AS revenue FROM fu WHERE filing_date <= DATE '{AS_OF}'),
rk AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY e DESC) AS i FROM kn),
q4 AS (SELECT company, count(*) AS c, sum(revenue) AS rq, sum(net_income) AS nq, max(e) - min(s) AS span FROM rk WHERE i <= 4 GROUP BY 1),
nw AS (SELECT company, max(filing_date) AS latest_filing, arg_max(total_assets, (e, filing_date)) AS total_assets, arg_max(revenue, (e, filing_date)) * 365.0 / arg_max(e - s, (e, filing_date)) AS rs,
    arg_max(net_income, (e, filing_date)) * 365.0 / arg_max(e - s, (e, filing_date)) AS ns FROM kn GROUP BY 1),
fp AS (SELECT company, latest_filing, total_assets, CASE WHEN c = 4 AND span BETWEEN 250 AND 400 THEN rq ELSE rs END AS revenue, CASE WHEN c = 4 AND span BETWEEN 250 AND 400 THEN nq ELSE ns END AS net_income FROM nw JOIN q4 USING (company))"""


@query(_FACTS + " SELECT company, round(revenue, 3) AS revenue, round(net_income, 3) AS net_income, round(total_assets, 3) AS total_assets, latest_filing FROM fp")
def facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Trailing and instant values of every company from its tagged facts known on a date, by the tag that it uses."""
    p = facts.facts_panel(company_facts(spark, d), AS_OF)
    return rounded(p.select("company", "revenue", "net_income", "total_assets", "latest_filing"), 3)


@query(_FACTS + f""", lc AS (SELECT security_id AS company, arg_max(close, observation_date) * 1e5 AS cap FROM px WHERE observation_date <= DATE '{AS_OF}' GROUP BY 1)
SELECT company, round(CASE WHEN cap > 1 THEN least(greatest(net_income / cap, -10), 10) END, 6) AS earnings_yield, round(CASE WHEN cap > 1 THEN least(greatest(revenue / cap, -10), 10) END, 6) AS sales_to_price,
 round(CASE WHEN total_assets > 1 THEN least(greatest(net_income / total_assets, -10), 10) END, 6) AS return_on_assets FROM fp LEFT JOIN lc USING (company)""")
def facts_value_quality(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of the facts panel with market caps of the last closes."""
    p = facts.facts_panel(company_facts(spark, d), AS_OF).withColumnRenamed("company", "security_id")
    shares = p.select("security_id", F.lit(1e5).alias("shares_outstanding"))
    bars = V.prices(spark, d).where(F.col("observation_date") <= F.lit(AS_OF))
    r = facts.facts_ratios(scorecard.with_market_cap(p, bars, shares))
    return rounded(r.select(F.col("security_id").alias("company"), "earnings_yield", "sales_to_price", "return_on_assets"))


#: Further items of the derived filings, each a fixed share of one that they have; plain values for Spark and SQL alike.
ITEMS = {
    "gross_profit": "revenue * 0.3", "operating_income": "net_income * 1.2 - revenue * 0.01", "interest_expense": "revenue * 0.02", "operating_cash_flow": "net_income * 0.8", "free_cash_flow": "net_income * 0.5 - 100",
    "share_repurchases": "revenue * 0.01", "total_equity": "total_assets * 0.4", "total_debt": "total_assets * 0.3", "eps": "net_income / 1000.0", "consensus_eps": "revenue / 12000.0",
}
_F = "PARTITION BY security_id ORDER BY available_at, fiscal_period_end"
_FLOW = ("revenue", "net_income", "gross_profit", "operating_income", "interest_expense", "operating_cash_flow", "free_cash_flow", "share_repurchases")
_WHOLE = V.with_sql(V.FUNDAMENTALS, V.MONTH_ENDS) + ", fi AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in ITEMS.items()) + " FROM fu),\ntt AS (SELECT *, " + ", ".join(
    f"CASE WHEN count({c}) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 4 THEN sum({c}) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS {c}_ttm" for c in _FLOW
) + f""", CASE WHEN abs(revenue) > 1e-6 THEN operating_income / revenue END AS margin, least(greatest((eps - consensus_eps) / greatest(abs(consensus_eps), 1e-6), -5), 5) AS earnings_surprise FROM fi WINDOW w AS ({_F})),
ms AS (SELECT *, CASE WHEN count(margin) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 4 THEN -stddev_samp(margin) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS margin_stability FROM tt WINDOW w AS ({_F})),
an AS (SELECT i.security_id, me.as_of, ms.* EXCLUDE (security_id) FROM (SELECT DISTINCT security_id FROM px) i CROSS JOIN me LEFT JOIN ms ON ms.security_id = i.security_id AND ms.available_at <= me.as_of::TIMESTAMP
  QUALIFY row_number() OVER (PARTITION BY i.security_id, me.as_of ORDER BY ms.available_at DESC NULLS LAST, ms.fiscal_period_end DESC) = 1),
cp AS (SELECT an.*, p.close * 1e5 AS market_cap FROM an ASOF LEFT JOIN px p ON p.security_id = an.security_id AND p.observation_date <= an.as_of)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) > 1e-6 AND ({a}) IS NOT NULL THEN least(greatest(({a}) / {b}, -100), 100) END"


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    filings = features_fund.filing_features(V.fundamentals(spark, d).withColumns({n: F.expr(e) for n, e in ITEMS.items()}))
    bars = V.prices(spark, d)
    grid = bars.select("security_id").distinct().crossJoin(F.broadcast(V.month_ends(spark, d)))
    a = features_fund.attach(grid, filings)
    a = asof.as_of_join(a, bars.select("security_id", F.col("observation_date").alias("_bar"), F.col("close").alias("_close")), "security_id", "as_of", "_bar")
    return features_fund.ratios(a.withColumn("market_cap", F.col("_close") * 1e5))


_RATIOS = features_fund.VALUE | features_fund.QUALITY


@query(_WHOLE + " SELECT security_id, as_of, " + ", ".join(f"round({_ratio(a, b)}, 6) AS {n}" for n, (a, b) in _RATIOS.items()) + f", round({_ratio('net_income_ttm - operating_cash_flow_ttm', 'total_assets')}, 6) AS accruals FROM cp")
def value_quality_all(spark: SparkSession, d: str) -> DataFrame:
    """All eleven value and quality ratios and the accruals of every name at each month end."""
    return rounded(_ratios(spark, d).select("security_id", "as_of", *_RATIOS, "accruals"))


@query(_WHOLE + """ SELECT security_id, as_of, round(margin_stability, 6) AS margin_stability, round(earnings_surprise, 6) AS earnings_surprise,
 round(earnings_surprise * (1 - least(greatest((as_of - filing_date) / 90.0, 0), 1)), 6) AS pead_proxy FROM cp""")
def earnings_quality(spark: SparkSession, d: str) -> DataFrame:
    """Margin stability, earnings surprise and the drift that follows it."""
    return rounded(_ratios(spark, d).select("security_id", "as_of", "margin_stability", "earnings_surprise", "pead_proxy"))
