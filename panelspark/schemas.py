"""Declared schemas of the tables that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PIT = "available_at timestamp, source string"
SCHEMAS = {
    "prices": f"security_id string, observation_date date, open double, high double, low double, close double, adjusted_close double, volume double, dollar_volume double, shares_outstanding double, {PIT}",
    "benchmark": f"observation_date date, close double, adjusted_close double, benchmark_return double, {PIT}",
    "securities": "security_id string, security_type string, primary_symbol string, name string, exchange string, sector string, industry string, country string, currency string, first_trade_date date, delisting_date date, delisting_reason string, delisting_return double",
    "identifiers": "security_id string, identifier_type string, identifier_value string, start_date date, end_date date, is_primary boolean",
    "membership": f"security_id string, universe string, start_date date, end_date date, is_survivorship_biased boolean, {PIT}",
    "corporate_actions": f"security_id string, action_type string, ex_date date, record_date date, payment_date date, value double, old_symbol string, new_symbol string, delisting_reason string, {PIT}",
    "fundamentals": f"security_id string, observation_date date, fiscal_period_end date, filing_date date, revenue double, net_income double, gross_profit double, operating_income double, interest_expense double, total_assets double, total_equity double, total_debt double, operating_cash_flow double, free_cash_flow double, capital_expenditure double, shares_outstanding double, eps double, consensus_eps double, {PIT}",
    "macro": f"series_id string, observation_date date, value double, revision_id long, is_revision boolean, {PIT}",
    "factors": "observation_date date, mkt_rf double, smb double, hml double, rf double, source string",
}
REQUIRED = {
    "prices": ["security_id", "observation_date", "close"],
    "benchmark": ["observation_date", "close"],
    "membership": ["security_id", "universe", "start_date"],
    "corporate_actions": ["security_id", "action_type", "ex_date"],
    "fundamentals": ["security_id", "fiscal_period_end"],
    "macro": ["series_id", "observation_date", "value"],
    "securities": ["security_id"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def require(df: DataFrame, *columns: str, what: str = "table") -> DataFrame:
    """The frame, or ValueError that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(lacking)}")
    return df
