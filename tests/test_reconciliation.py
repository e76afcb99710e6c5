"""Reconciliation of orders whose reference price is zero."""

from panelspark.operators import ledger
from panelspark.plans import registry
from tests.oracle import duck, rows


def test_zero_reference_price(spark):
    orders = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0), (4, 100.0), (5, 100.0), (6, None)], "order_id long, reference_price double").selectExpr("*", "'buy' AS side", "3.0D AS quantity", "0.0D AS expected_cost")
    fills = spark.createDataFrame([(1, 3.0, 0.0), (2, 3.0, 0.5), (4, 2.0, 100.5), (5, 3.0, 102.0), (6, 3.0, 1.0)], "order_id long, quantity double, price double").selectExpr("*", "0.0D AS cost")
    got = {r["order_id"]: list(r["warnings"]) for r in ledger.reconcile(orders, fills).collect()}
    assert got == {1: [], 2: ["price_gap"], 3: ["unfilled"], 4: ["partial"], 5: ["price_gap"], 6: []}


def test_query_over_a_purchase_of_zero(spark, tmp_path):
    con = duck()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(registry.SQL["order_reconciliation"]).df()
    got = registry.QUERIES["order_reconciliation"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(want[got.columns])
