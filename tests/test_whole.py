"""Registered queries over all their rows, against their SQL without its cuts.

The SQL of some queries takes a part of the names or of the years; ``uncut`` gives it
with that part widened to the whole, for these tests only.
"""

from panelspark.plans import registry
from tests.oracle import DIR, same


def uncut(name: str, *cuts: tuple[str, str]) -> str:
    sql = registry.SQL[name]
    for old, new in cuts:
        assert old in sql or new in sql
        sql = sql.replace(old, new)
    return sql


NAMES = (" WHERE security_id % 10 < 3", "")


def test_returns_of_all_names(spark):
    for name in ("portfolio_metrics", "psr_inputs", "half_sample_sharpe", "acceptance_gates", "snapshot_digest"):
        same(spark, registry.QUERIES[name], uncut(name, NAMES))


def test_pbo_of_all_names_over_70_splits(spark):
    blocks = [("* 6 / n), 5)", "* 8 / n), 7)"), ("range(0, 64)", "range(0, 256)"), ("bit_count(i::INT) = 3", "bit_count(i::INT) = 4")]
    same(spark, registry.QUERIES["pbo"], uncut("pbo", NAMES, *blocks))


def test_risk_of_all_names(spark):
    for name in ("betas", "pairwise_covariance", "risk_contribution"):
        same(spark, registry.QUERIES[name], uncut(name, (" AND security_id < 40", "")), "/root/testdata/sf0.01")
    assert registry.QUERIES["shrunk_covariance"](spark, "/root/testdata/sf0.01").select("id_i").distinct().count() > 40


def test_sessions_of_all_years(spark):
    years = ("range(1997, 2003)", "range((SELECT min(year(l_shipdate)) FROM lineitem)::INT, (SELECT max(year(l_shipdate)) FROM lineitem)::INT + 2)")
    same(spark, registry.QUERIES["session_table"], uncut("session_table", years, ("greatest(min(l_shipdate), DATE '1997-01-01')", "min(l_shipdate)")))
