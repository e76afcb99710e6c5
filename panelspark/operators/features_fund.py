"""Fundamental features: trailing sums and growth by filing, attached point in time, then ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clean, clip, ratio
from panelspark.functions.windows import ID
from panelspark.operators.asof import as_of_join

FLOWS = ["revenue", "net_income", "gross_profit", "operating_income", "interest_expense", "operating_cash_flow", "free_cash_flow", "capital_expenditure", "share_repurchases"]
FLOOR = 1e-6


def _filed():
    return Window.partitionBy(ID).orderBy("available_at", "fiscal_period_end")


def filing_features(fundamentals: DataFrame) -> DataFrame:
    """Each filing with TTM sums (4 filings, all needed), year-on-year growth, margin stability and earnings surprise.

    Item columns that are absent are skipped, as are the features that need them.
    """
    w = _filed()
    have = [c for c in FLOWS if c in fundamentals.columns]
    df = fundamentals.withColumns({c: clean(F.col(c).cast("double")) for c in have})
    last4 = w.rowsBetween(-3, 0)
    df = df.withColumns({f"{c}_ttm": F.when(F.count(c).over(last4) >= 4, F.sum(c).over(last4)) for c in have})

    def growth(c: str):
        before = F.lag(c, 4).over(w)
        return ratio(F.col(c) - before, F.abs(before), FLOOR)

    pairs = {"revenue_growth": "revenue_ttm", "earnings_growth": "net_income_ttm", "asset_growth": "total_assets", "share_issuance": "shares_outstanding", "capex_growth": "capital_expenditure_ttm"}
    df = df.withColumns({name: growth(c) for name, c in pairs.items() if c in df.columns})
    if {"operating_income", "revenue"} <= set(have):
        last8 = w.rowsBetween(-7, 0)
        margin = ratio(F.col("operating_income"), F.col("revenue"), FLOOR)
        df = df.withColumn("_margin", margin)
        df = df.withColumn("margin_stability", F.when(F.count("_margin").over(last8) >= 4, -F.stddev_samp("_margin").over(last8))).drop("_margin")
    if {"eps", "consensus_eps"} <= set(df.columns):
        gap = (F.col("eps") - F.col("consensus_eps")) / F.greatest(F.abs("consensus_eps"), F.lit(FLOOR))
        df = df.withColumn("earnings_surprise", clip(gap, -5.0, 5.0))
    return df


def attach(panel: DataFrame, filings: DataFrame, day: str = "as_of", columns: Sequence[str] | None = None) -> DataFrame:
    """Each (security, day) with the values of its latest filing known at midnight of the day."""
    book = {"available_at", "ingested_at", "source", "source_record_id", "revision_id", "observation_date", "data_quality_status"}
    keep = [c for c in (columns or filings.columns) if c not in book and c != ID]
    order = [c for c in ("fiscal_period_end", "revision_id") if c in filings.columns]
    side = filings.select(ID, "available_at", *dict.fromkeys([*keep, *order]))
    return as_of_join(panel, side, ID, day, "available_at", order=order).drop("available_at", *[c for c in order if c not in keep])


VALUE = {"earnings_yield": ("net_income_ttm", "market_cap"), "book_to_market": ("total_equity", "market_cap"), "sales_to_price": ("revenue_ttm", "market_cap"), "fcf_yield": ("free_cash_flow_ttm", "market_cap"), "repurchase_activity": ("share_repurchases_ttm", "market_cap")}
QUALITY = {"gross_profitability": ("gross_profit_ttm", "total_assets"), "return_on_equity": ("net_income_ttm", "total_equity"), "return_on_assets": ("net_income_ttm", "total_assets"), "operating_margin": ("operating_income_ttm", "revenue_ttm"), "debt_to_assets": ("total_debt", "total_assets"), "interest_coverage": ("operating_income_ttm", "interest_expense_ttm")}


def ratios(attached: DataFrame, day: str = "as_of", bound: float = 100.0, floor: float = FLOOR) -> DataFrame:
    """Value and quality ratios, accruals and the post-earnings drift proxy, where their inputs are there; clipped to +-bound."""
    have = set(attached.columns)
    out = {n: clip(ratio(F.col(a), F.col(b), floor), -bound, bound) for n, (a, b) in (VALUE | QUALITY).items() if {a, b} <= have}
    if {"net_income_ttm", "operating_cash_flow_ttm", "total_assets"} <= have:
        out["accruals"] = clip(ratio(F.col("net_income_ttm") - F.col("operating_cash_flow_ttm"), F.col("total_assets"), floor), -bound, bound)
    if {"earnings_surprise", "filing_date"} <= have:
        age = F.datediff(F.col(day), "filing_date") / F.lit(90.0)
        out["pead_proxy"] = F.col("earnings_surprise") * (1 - clip(age, 0.0, 1.0))
    return attached.withColumns(out)


def available(df: DataFrame) -> list[str]:
    """The fundamental features that a frame holds."""
    names = [*VALUE, *QUALITY, "accruals", "pead_proxy", "revenue_growth", "earnings_growth", "asset_growth", "share_issuance", "capex_growth", "margin_stability", "earnings_surprise"]
    return [n for n in names if n in df.columns]
