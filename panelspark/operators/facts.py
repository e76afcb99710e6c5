"""Company facts as of a date: tag fallback, trailing-twelve-month and instant values, ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clip, ratio

# Concepts with the tags that may hold them, best first.
TAGS: Mapping[str, Sequence[str]] = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "operating_income": ("OperatingIncomeLoss",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "capital_expenditure": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "total_assets": ("Assets",),
    "total_equity": ("StockholdersEquity",),
    "total_debt": ("LongTermDebt", "LongTermDebtNoncurrent"),
    "shares_outstanding": ("EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding"),
}
INSTANT = ("total_assets", "total_equity", "total_debt", "shares_outstanding")


def by_concept(facts: DataFrame, as_of, tags: Mapping[str, Sequence[str]] = TAGS, units: Sequence[str] = ("USD", "shares")) -> DataFrame:
    """Facts filed by ``as_of`` under each concept's first tag that the company has any of, in its best unit."""
    spark = facts.sparkSession
    rank = spark.createDataFrame([(c, t, i) for c, ts in tags.items() for i, t in enumerate(ts)], "concept string, tag string, tag_rank int")
    unit_rank = F.coalesce(F.array_position(F.array(*[F.lit(u) for u in units]), F.col("unit")), F.lit(0))
    known = facts.where((F.col("filed") <= F.lit(as_of).cast("date")) & F.col("value").isNotNull())
    known = known.join(F.broadcast(rank), "tag").withColumn("_u", F.when(unit_rank > 0, unit_rank).otherwise(99))
    w = Window.partitionBy("company", "concept").orderBy("tag_rank", "_u")
    return known.withColumn("_r", F.dense_rank().over(w)).where("_r = 1").drop("_r", "_u", "tag_rank")


def latest_instant(concepts: DataFrame, names: Sequence[str] = INSTANT) -> DataFrame:
    """(company, concept, value, filed): the value of the latest period, of its latest filing."""
    rows = concepts.where(F.col("concept").isin(list(names)))
    return rows.groupBy("company", "concept").agg(F.max_by("value", F.struct("end", "filed")).alias("value"), F.max("filed").alias("filed"))


def trailing_flow(concepts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(company, concept, value, filed): four newest distinct quarters that span 250-400 days, else the newest year, else the newest period scaled to a year."""
    rows = concepts.where(F.col("start").isNotNull() & ~F.col("concept").isin(list(INSTANT)))
    if names is not None:
        rows = rows.where(F.col("concept").isin(list(names)))
    rows = rows.withColumn("days", F.datediff("end", "start"))
    rows = rows.groupBy("company", "concept", "start", "end", "days").agg(F.max_by("value", "filed").alias("value"), F.max("filed").alias("filed"))
    group = ["company", "concept"]
    quarters = rows.where(F.col("days").between(60, 110)).groupBy(*group, "end").agg(F.max_by("value", F.struct("filed", "start")).alias("value"), F.max("start").alias("start"), F.max("filed").alias("filed"))
    quarters = quarters.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("end").desc()))).where("_n <= 4")
    four = quarters.groupBy(*group).agg(F.count("*").alias("_c"), F.sum("value").alias("_q"), F.datediff(F.max("end"), F.min("start")).alias("_span"), F.max("filed").alias("_qf"))
    years = rows.where(F.col("days").between(330, 400)).groupBy(*group).agg(F.max_by("value", F.struct("end", "filed")).alias("_y"), F.max("filed").alias("_yf"))
    newest = F.struct("end", "days", "filed")
    other = rows.where("days > 0").groupBy(*group).agg((F.max_by("value", newest) * 365.0 / F.max_by("days", newest)).alias("_s"), F.max("filed").alias("_sf"))
    out = other.join(years, group, "left").join(four, group, "left")
    good = (F.col("_c") == 4) & F.col("_span").between(250, 400)
    return out.select(*group, F.coalesce(F.when(good, F.col("_q")), F.col("_y"), F.col("_s")).alias("value"), F.greatest("_sf", F.coalesce("_yf", "_sf")).alias("filed"))


def facts_panel(facts: DataFrame, as_of, tags: Mapping[str, Sequence[str]] = TAGS) -> DataFrame:
    """One row a company: a column a concept and the latest filing date."""
    c = by_concept(facts, as_of, tags)
    rows = latest_instant(c).unionByName(trailing_flow(c))
    values = rows.groupBy("company").pivot("concept", list(tags)).agg(F.first("value"))
    return values.join(rows.groupBy("company").agg(F.max("filed").alias("latest_filing")), "company")


def facts_ratios(panel: DataFrame, market_cap: str = "market_cap") -> DataFrame:
    """Value and quality ratios of a facts panel with a market cap: denominators over 1.0, clipped to +-10."""
    r = lambda a, b: clip(ratio(F.col(a) if isinstance(a, str) else a, F.col(b), 1.0), -10.0, 10.0)
    fcf = F.col("operating_cash_flow") - F.col("capital_expenditure")
    return panel.withColumns({
        "earnings_yield": r("net_income", market_cap), "book_to_market": r("total_equity", market_cap), "sales_to_price": r("revenue", market_cap), "fcf_yield": r(fcf, market_cap),
        "return_on_equity": r("net_income", "total_equity"), "return_on_assets": r("net_income", "total_assets"), "operating_margin": r("operating_income", "revenue"), "debt_to_assets": r("total_debt", "total_assets"),
    })
