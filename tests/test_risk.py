"""Blocked covariance against numpy, and plans that do not repeat their base frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import risk
from panelspark.plans import registry
from tests.oracle import DIR


def returns(spark, names, days, gaps, seed=1):
    rnd = np.random.default_rng(seed)
    common = rnd.normal(size=days)
    rows = [(f"n{i}", t, float(0.5 * common[t] + rnd.normal())) for i in range(names) for t in range(days) if rnd.random() > gaps]
    return spark.createDataFrame(rows, "security_id string, t int, r double").select("security_id", F.date_add(F.lit("2001-01-01").cast("date"), F.col("t")).alias("observation_date"), "r"), rows


@pytest.mark.parametrize("size", [1, 3, 256])
def test_blocks(spark, size):
    df, rows = returns(spark, 11, 90, 0.2)
    df = df.unionByName(spark.createDataFrame([("thin", None, 1.0), (None, None, 1.0), ("n1", None, None)], df.schema).withColumn("observation_date", F.lit("2001-01-05").cast("date")))
    got = {(r["id_i"], r["id_j"]): r["cov"] for r in risk.covariance(df, least=30, size=size).collect()}
    x = np.zeros((11, 90))
    for name, t, r in rows:
        x[int(name[1:]), t] = r
    x = x[:, x.any(axis=0)]
    want = np.cov(x) * risk.YEAR
    assert len(got) == 121
    for (i, j), c in got.items():
        assert c == pytest.approx(want[int(i[1:]), int(j[1:])], rel=1e-9, abs=1e-12)


def test_empty_and_single(spark):
    df, _ = returns(spark, 1, 40, 0.0)
    assert risk.covariance(df, least=10).count() == 1
    assert risk.covariance(df, least=100).count() == 0
    assert risk.covariance(df.limit(0)).count() == 0
    one_day = df.limit(1)
    assert risk.covariance(one_day, least=1).first()["cov"] is None


def test_many_names_without_a_row_a_pair_and_day(spark):
    df, _ = returns(spark, 900, 60, 0.0)
    cov = risk.covariance(df, least=30)
    assert cov.count() == 900 * 900
    some = {(r["id_i"], r["id_j"]): r["cov"] for r in cov.where("id_i IN ('n3', 'n777') AND id_j IN ('n3', 'n777')").collect()}
    assert some["n3", "n777"] == pytest.approx(some["n777", "n3"]) and some["n3", "n3"] > 0


def test_base_frames_are_planned_once(spark):
    for name in ("concentration", "risk_contribution", "shrunk_covariance", "pairwise_covariance", "factor_turnover", "pbo"):
        plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("lineitem.parquet") <= 4, name
