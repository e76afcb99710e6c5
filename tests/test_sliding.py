"""Sliding windows against windows worked out one by one."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import sliding as S
from panelspark.operators.features_price import FAMILIES, price_features

RND = np.random.default_rng(8)


def windows(x, n):
    for t in range(len(x)):
        w = x[max(0, t - n + 1) : t + 1]
        yield w[np.isfinite(w)]


def each(x, n, least, f):
    return np.array([f(w) if len(w) >= max(least, 1) else np.nan for w in windows(x, n)])


def gappy(n):
    x = RND.normal(size=n)
    x[RND.random(n) < 0.1] = np.nan
    return x


@pytest.mark.parametrize("size", [0, 1, 2, 7, 100, 257])
@pytest.mark.parametrize("n", [1, 2, 7, 20, 63])
def test_sums_extremes_and_moments(size, n):
    x = gappy(size)
    for f, want, least in ((S.mean, np.mean, 1), (S.mean, np.mean, n), (S.highest, np.max, 1), (S.lowest, np.min, n // 2)):
        assert np.allclose(f(x, n, least), each(x, n, least, want), equal_nan=True)
    assert np.allclose(S.deviation(x, n, 2), each(x, n, 2, lambda w: np.std(w, ddof=1)), equal_nan=True)
    y = 0.5 * np.nan_to_num(x) + gappy(size)
    slope, corr, r2 = S.regression(y, x, n, 3)
    for t in range(size):
        a, b = y[max(0, t - n + 1) : t + 1], x[max(0, t - n + 1) : t + 1]
        ok = np.isfinite(a) & np.isfinite(b)
        if ok.sum() < 3:
            assert np.isnan([slope[t], corr[t], r2[t]]).all()
        else:
            c = np.cov(a[ok], b[ok])
            assert np.allclose([slope[t], corr[t], r2[t]], [c[0, 1] / c[1, 1], np.corrcoef(a[ok], b[ok])[0, 1], np.corrcoef(a[ok], b[ok])[0, 1] ** 2])


def test_small_steps_far_from_zero_and_after_large_ones():
    steps = RND.normal(size=400) * 1e-6
    x = np.concatenate([1e6 + steps[:200], 5 + steps[200:]])  # levels of 1e6, steps of 1e-6
    got = S.deviation(x, 50, 50)
    for t in (49, 120, 199, 260, 399):
        w = x[t - 49 : t + 1]
        assert got[t] == pytest.approx(np.std(w - w[0], ddof=1), rel=1e-9)
    flat = np.concatenate([RND.normal(size=100) * 1e3, np.full(100, 0.1)])
    assert (S.deviation(flat, 50, 2)[150:] == 0).all()
    slope, corr, r2 = S.regression(flat, np.arange(200.0), 50, 2)
    assert (slope[150:] == 0).all() and np.isnan(corr[150:]).all() and (r2[150:] == 1).all()


@pytest.mark.parametrize("n", [63, 252, 1008])
def test_quantiles(n):
    x = gappy(1500)
    x[300:340] = x[5]  # ties
    tool, got = S.SlidingQuantile(n, 0.05, n // 2), []
    for lo in range(0, 1500, 170):
        got.append(tool.push(x[lo : lo + 170]))
    assert np.allclose(np.concatenate(got), each(x, n, n // 2, lambda w: np.quantile(w, 0.05)), equal_nan=True)


def test_cost_follows_rows_not_windows():
    x = RND.normal(size=60_000)

    def took(n):
        began = time.process_time()
        S.SlidingQuantile(n, 0.05, 10).push(x)
        S.deviation(x, n, 10), S.highest(x, n, 10)
        return time.process_time() - began

    took(63)
    assert min(took(1008) for _ in range(3)) < 3 * min(took(63) for _ in range(3)) + 0.1


def test_batches_make_no_difference(spark):
    rows = []
    for name, n in (("a", 900), ("b", 3), (None, 40), ("c", 400)):
        p = 50 * np.exp(np.cumsum(RND.normal(scale=0.02, size=n)))
        for t in range(n):
            rows.append((name, t, None if t % 41 == 40 else float(p[t]), float(p[t] * 1.1), float(p[t] * 0.9), float(RND.integers(0, 9)), None if t % 13 == 5 else float(RND.integers(1, 99))))
    bars = spark.createDataFrame(rows, "security_id string, t int, adjusted_close double, high double, low double, volume double, dollar_volume double").select(F.date_add(F.lit("2001-01-01").cast("date"), F.col("t")).alias("observation_date"), "*")
    bench = bars.where("security_id = 'a' AND adjusted_close IS NOT NULL").select("observation_date", (F.col("adjusted_close") + 30).alias("close"))
    names = ["security_id", "as_of", *[f for fs in FAMILIES.values() for f in fs]]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = price_features(bars, bench).select(names).toPandas()
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "37")
        cut = price_features(bars.repartition(3), bench).select(names).toPandas()
    finally:
        spark.conf.set(key, before)
    a, b = (d.sort_values(["security_id", "as_of"]).reset_index(drop=True) for d in (whole, cut))
    assert len(a) == len(rows) and (a[names[:2]].astype(str) == b[names[:2]].astype(str)).all().all()
    assert np.allclose(a[names[2:]].astype(float), b[names[2:]].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True)
    assert price_features(bars.limit(0), bench).count() == 0
    assert a["turnover_21d"].isna().all() and a["momentum_252d"].notna().sum() > 500
