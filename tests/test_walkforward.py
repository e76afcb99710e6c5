"""Walk-forward fits from moments against fits on each fold's own rows."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import models, splits, walkforward
from panelspark.plans import registry, states
from tests.oracle import DIR

FEATURES = ["f1", "f2", "f3", "f4"]
START = date(2000, 1, 3)


@pytest.fixture(scope="module")
def panel(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for t in range(0, 330):
        day = START + timedelta(days=7 * t)
        for i in range(9):
            x = rnd.normal(size=4) + [1e3, 0, 0, 0]
            x[3] = x[1] + 0.5 * rnd.normal()
            y = 0.3 * (x[0] - 1e3) - 0.2 * x[1] + 0.02 * x[2] + 0.5 * rnd.normal() + 7
            f = [None if rnd.random() < 0.03 else float("nan") if rnd.random() < 0.01 else float(v) for v in x]
            rows.append((f"s{i}", day, day + timedelta(days=int(rnd.integers(10, 60))), *f, None if rnd.random() < 0.02 else float(y)))
    return spark.createDataFrame(rows, "security_id string, as_of date, window_end date, f1 double, f2 double, f3 double, f4 double, y double").cache()


@pytest.fixture(scope="module")
def setting(spark):
    cal = spark.createDataFrame([(START + timedelta(days=i), i) for i in range(2400)], "session date, idx long")
    return splits.folds(spark, START, date(2006, 3, 1)), cal


@pytest.mark.parametrize("purge", [True, False])
def test_moments_are_those_of_each_folds_training_rows(panel, setting, purge):
    schedule, cal = setting
    folds, shift = walkforward.moments(panel, FEATURES, "y", schedule, cal, 15, purge)
    split = splits.split_panel(panel, schedule, cal, 15, purge).where("split = 'train'")
    assert len(folds) == schedule.count() > 4
    for f in folds:
        x = models.training_rows(split.where(F.col("fold") == f.fold), FEATURES, "y").select(*FEATURES, "y").toPandas().to_numpy()
        assert f.n == len(x)
        assert np.allclose(f.mean + shift, x.mean(axis=0), rtol=1e-12) and np.allclose(f.cov, np.cov(x.T, ddof=0), rtol=1e-8, atol=1e-10)


@pytest.mark.parametrize("alpha, l1_ratio", [(0.0, 0.5), (0.01, 0.5), (0.05, 1.0), (0.1, 0.0)])
def test_coefficients_equal_those_of_the_learner(panel, setting, alpha, l1_ratio):
    schedule, cal = setting
    table, scores = walkforward.walk_forward(panel, FEATURES, "y", schedule, cal, 15, alpha=alpha, l1_ratio=l1_ratio)
    got = {(r["fold"], r["feature"]): r["coefficient"] for r in table.collect()}
    split = splits.split_panel(panel, schedule, cal, 15)
    for fold in (0, 3):
        mine = split.where(F.col("fold") == fold)
        m = models.elastic_net(mine.where("split = 'train'"), FEATURES, "y", alpha, l1_ratio)
        assert np.allclose([got[fold, f] for f in FEATURES], m.model.stages[-1].coefficients.toArray(), atol=1e-6)
        want = {(r["security_id"], r["as_of"]): r for r in m.predict(mine.where("split <> 'train'")).collect()}
        have = scores.where(F.col("fold") == fold).collect()
        assert len(have) == len(want) and {r["split"] for r in have} == {"validation", "test"}
        for r in have:
            w = want[r["security_id"], r["as_of"]]
            assert abs(r["prediction"] - w["prediction"]) < 1e-4 and abs(r["cross_sectional_rank"] - w["cross_sectional_rank"]) < 0.3


def test_scaled_nets_penalise_by_training_deviation(panel, setting):
    schedule, cal = setting
    blown = panel.withColumn("f2", F.col("f2") * 1000)
    a = {(r["fold"], r["feature"]): r["coefficient"] for r in walkforward.walk_forward(panel, FEATURES, "y", schedule, cal, alpha=0.05, scaled=True)[0].collect()}
    b = {(r["fold"], r["feature"]): r["coefficient"] for r in walkforward.walk_forward(blown, FEATURES, "y", schedule, cal, alpha=0.05, scaled=True)[0].collect()}
    for (fold, f), v in a.items():
        assert abs(v - b[fold, f] * (1000 if f == "f2" else 1)) < 1e-7


def test_refusals_and_empty_tables(spark, panel, setting):
    schedule, cal = setting
    with pytest.raises(ValueError, match="target"):
        walkforward.moments(panel, ["f1", "y"], "y", schedule)
    with pytest.raises(ValueError, match="no complete"):
        walkforward.moments(panel.limit(0), FEATURES, "y", schedule)
    with pytest.raises(ValueError, match="expand"):
        walkforward.moments(panel, FEATURES, "y", schedule.withColumn("train_start", F.col("validation_start")))
    assert walkforward.moments(panel, FEATURES, "y", schedule.limit(0))[0] == []


def test_query_fits_every_fold_from_one_copy_of_the_panel(spark):
    table = registry.QUERIES["walk_forward_coefficients"](spark, DIR)
    assert sorted({r["fold"] for r in table.collect()}) == sorted(r["fold"] for r in states._schedule(spark).collect()) and table.count() == 21
