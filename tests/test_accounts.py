"""Account marks and monitoring by hand."""

from datetime import date, datetime

import numpy as np
import pytest

from panelspark.operators import accounts, calendar

FILL = "account string, security_id string, ts timestamp, side string, quantity double, price double, cost double"


def test_paths_and_monitoring(spark):
    d = lambda i: date(2024, 3, i)
    cal = calendar.numbered(spark.createDataFrame([(d(i),) for i in (1, 4, 5, 6, 7)], "session date"))
    fills = spark.createDataFrame([
        ("a", "x", datetime(2024, 3, 1, 10), "buy", 10.0, 10.0, 1.0), ("a", "x", datetime(2024, 3, 2, 10), "buy", 5.0, 11.0, None),  # a Saturday: Monday's session
        ("a", "x", datetime(2024, 3, 6, 10), "sell", 15.0, 12.0, 2.0), ("a", "y", datetime(2024, 3, 5, 9), "sell", 1.0, 50.0, 0.0), ("a", "y", datetime(2024, 3, 5, 9), "buy", None, 50.0, 0.0),
        ("b", "z", datetime(2024, 3, 7, 9), "buy", 2.0, 5.0, 0.0), (None, "x", datetime(2024, 3, 7, 9), "buy", 1.0, 5.0, 0.0),
    ], FILL)
    prices = spark.createDataFrame([("x", d(1), 10.0), ("x", d(5), 9.0), ("x", d(6), 12.0), ("y", d(5), 50.0), ("y", d(7), 40.0)], "security_id string, observation_date date, close double")
    e = accounts.equity_paths(fills, prices, cal, 1000.0)
    got = {(r["account"], r["as_of"].day): r for r in e.collect()}
    assert [round(got["a", i]["total_value"], 6) for i in (1, 4, 5, 6, 7)] == [999.0, 994.0, 979.0, 1022.0, 1032.0]
    assert [got["a", i]["n_positions"] for i in (1, 4, 5, 6, 7)] == [1, 1, 2, 1, 1] and got["a", 7]["costs"] == 3
    assert got["b", 7]["n_unpriced"] == 1 and got["b", 7]["total_value"] == 990 and ("b", 6) not in got
    costs = spark.createDataFrame([("a", 10.0, 12.0), ("a", 5.0, 5.0), ("a", 0.0, 1.0)], "account string, expected_cost double, realised_cost double")
    m = {r["account"]: r for r in accounts.monitoring(e, 1000.0, costs).collect()}
    v = np.array([999.0, 994, 979, 1022, 1032])
    r = v[1:] / v[:-1] - 1
    assert m["a"]["sharpe"] == pytest.approx(r.mean() / r.std(ddof=1) * 252**0.5) and m["a"]["max_drawdown"] == pytest.approx(979 / 999 - 1)
    assert m["a"]["total_return"] == pytest.approx(0.032) and m["a"]["n_observations"] == 4 and m["a"]["return_since_first"] == pytest.approx(1032 / 999 - 1)
    assert (m["a"]["expected_cost"], m["a"]["realised_cost"], m["a"]["n_rebalances"]) == (15, 18, 3) and m["a"]["cost_surprise"] == pytest.approx(0.1)
    assert m["b"]["sharpe"] is None and m["b"]["max_drawdown"] is None and m["b"]["n_rebalances"] == 0
    assert accounts.monitoring(accounts.equity_paths(fills.limit(0), prices, cal)).count() == 0
