"""Registered queries against their SQL on the smallest data."""

import pytest

from panelspark.plans import registry
from tests.oracle import DIR, same


@pytest.mark.parametrize("name", ["momentum_top10_month_end", "returns_and_momentum", "asof_fundamentals", "macro_vintage_asof", "split_dividend_adjust", "session_table", "rename_intervals", "delisting_labels", "universe_exclusions", "purge_embargo_rows", "mandate_audit", "score_weight_capped", "average_cost", "pbo", "panel_build", "scoring_panel", "stress_cases", "equity_curve", "fold_safety", "shrunk_covariance", "session_shift", "walk_forward_elastic_net", "walk_forward_coefficients", "coefficient_stability", "feature_ablation", "facts_as_of", "value_quality_all", "earnings_quality", "planted_findings", "session_navigation", "single_split", "order_proposals", "participation_cap", "position_marks", "dividend_cash", "delisting_proceeds", "member_disagreement", "run_states", "run_report", "purpose_equity", "select_over_results", "account_equity", "account_monitoring", "stream_positions", "stream_bars", "stream_decisions", "stream_quality", "peers_compared"])
def test_query_matches_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


def test_every_query_without_sql_runs(spark):
    for name in ("sharpe_probabilities", "bootstrap_interval", "placebo_stress"):
        assert registry.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
