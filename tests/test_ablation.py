"""Ablations and placebo targets against separate walk-forward runs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.operators import ablation, metrics, walkforward
from tests.test_walkforward import FEATURES, panel, setting  # noqa: F401


def ics(scores, extra=()):
    return {(r["fold"]): r["mean_ic"] for r in metrics.ic_summary(metrics.ic_by_date(scores.where("split = 'test'"), "prediction", "y", ["fold"]), ["fold"]).collect()}


def test_each_case_is_the_run_of_its_features(spark, panel, setting):  # noqa: F811
    schedule, cal = setting
    groups = {"first": ["f1"], "twins": ["f2", "f4"]}
    complete = panel.where("f1 IS NOT NULL AND NOT isnan(f1) AND f2 IS NOT NULL AND NOT isnan(f2) AND f3 IS NOT NULL AND NOT isnan(f3) AND f4 IS NOT NULL AND NOT isnan(f4) AND y IS NOT NULL")
    got = ablation.stressed(complete, FEATURES, "y", schedule, groups, [3, 5], cal, 15, alpha=0.01)
    rows = {(r["scenario"], r["fold"]): r for r in got.collect()}
    assert Counter(r["category"] for r in rows.values()) == {"baseline": 5, "ablation": 10, "placebo": 10} or len(rows) >= 20
    for scenario, used in ablation.cases(FEATURES, groups).items():
        for fold, ic in ics(walkforward.walk_forward(complete, used, "y", schedule, cal, 15, alpha=0.01)[1]).items():
            assert rows[scenario, fold]["mean_ic"] == pytest.approx(ic, abs=1e-6)
    dealt = ablation.placebo_targets(complete.select("security_id", "as_of", "window_end", *FEATURES, "y"), "y", [3])
    scores = walkforward.walk_forward(dealt, FEATURES, "placebo_3", schedule, cal, 15, alpha=0.01)[1]
    real = scores.join(complete.select("security_id", "as_of", "y"), ["security_id", "as_of"])
    for fold, ic in ics(real).items():
        assert rows["placebo_3", fold]["mean_ic"] == pytest.approx(ic, abs=1e-6)
    table = {r["scenario"]: r for r in ablation.stress_rows(got).collect()}
    assert table["full"]["change"] == 0 and table["without_first"]["change"] < -0.1 and abs(table["placebo_3"]["mean_ic"]) < table["full"]["mean_ic"]


def test_placebo_targets_are_the_same_values_of_each_date(spark, panel):  # noqa: F811
    dealt = ablation.placebo_targets(panel.select("security_id", "as_of", "y"), "y", [1, 2])
    assert dealt.count() == panel.count()
    by = dealt.groupBy("as_of").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("y", "placebo_1", "placebo_2")])
    assert by.where("y <> placebo_1 OR y <> placebo_2").count() == 0
    assert dealt.where("NOT (y <=> placebo_1)").count() > dealt.count() / 2
    again = ablation.placebo_targets(panel.repartition(5).select("security_id", "as_of", "y"), "y", [1, 2])
    assert dealt.exceptAll(again.select(dealt.columns)).count() == 0


def test_nothing_left(panel, setting):  # noqa: F811
    with pytest.raises(ValueError, match="nothing is left"):
        ablation.stressed(panel, ["f1"], "y", setting[0], {"all": ["f1"]})
