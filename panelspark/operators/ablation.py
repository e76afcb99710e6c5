"""Feature ablations and placebo targets of walk-forward linear models, all in one pass over the panel.

The moments of a fold hold those of every subset of its features, so leaving features out is
a smaller matrix and no other job.  Targets dealt anew within their dates are further columns
of the same moments.  Every configuration is then predicted and scored in one more pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clean
from panelspark.functions.windows import ID
from panelspark.operators import metrics
from panelspark.operators.walkforward import KEY, _assigned, elastic_nets, moments
from panelspark.sources.shared import written


def placebo_targets(panel: DataFrame, target: str, seeds: Sequence[int], day: str = "as_of") -> DataFrame:
    """The panel with a column ``placebo_<seed>`` for each seed: the target's values dealt anew among the rows of each date.

    Rows of a date are lined up by security, and the values by a hash of seed and security, so the deal is the same at every run.
    """
    w = Window.partitionBy(day)
    lined = panel.withColumn("_i", F.row_number().over(w.orderBy(ID)))
    values = panel.select(day, ID, F.col(target).alias("_v"))
    for s in seeds:
        # one exchange by date for all seeds: rows stay with their date
        dealt = values.select(day, F.row_number().over(w.orderBy(F.xxhash64(F.lit(s), ID), ID)).alias("_i"), F.col("_v").alias(f"placebo_{s}"))
        lined = lined.join(dealt, [day, "_i"])
    return lined.drop("_i")


def cases(features: Sequence[str], groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The features of each case: ``full``, and ``without_<group>`` for each group."""
    out = {"full": list(features)}
    for name, gone in groups.items():
        left = [f for f in features if f not in gone]
        if not left:
            raise ValueError(f"nothing is left without {name}")
        out[f"without_{name}"] = left
    return out


def stressed(panel: DataFrame, features: Sequence[str], target: str, schedule: DataFrame, groups: Mapping[str, Sequence[str]], seeds: Sequence[int] = (), cal: DataFrame | None = None, embargo: int = 0, purge: bool = True, alpha: float = 1e-3, l1_ratio: float = 0.5, day: str = "as_of") -> DataFrame:
    """(category, scenario, fold, mean_ic, ic_std, share_positive, periods, ic_ir) on the test rows of each fold.

    Categories: ``baseline``, ``ablation`` (a group of features left out) and ``placebo`` (fitted
    on a target dealt anew; judged, like all, by the real one).  A scenario that predicts the
    same for all names of every date has no IC and no row.
    """
    names = [*features, target]
    plain = panel.select(*KEY, "window_end", *names)
    rows = written(placebo_targets(plain, target, seeds, day) if seeds else plain, "panel")
    targets = [target, *[f"placebo_{s}" for s in seeds]]
    # one matrix with every target: as further "features" but for the last, which the moments take as theirs
    folds, shift = moments(rows, [*features, *targets[1:]], target, schedule, cal, embargo, purge, day)
    place = {c: i for i, c in enumerate([*features, *targets[1:], target])}
    runs = [("baseline" if k == "full" else "ablation", k, fs, target) for k, fs in cases(features, groups).items()] + [("placebo", t, list(features), t) for t in targets[1:]]
    nets = []
    for category, scenario, used, goal in runs:
        at = [place[f] for f in used] + [place[goal]]
        part = [replace(f, mean=f.mean[at], cov=f.cov[np.ix_(at, at)]) for f in folds]
        for fold, _, c, w in elastic_nets(part, shift[at], alpha, l1_ratio):
            weight = dict(zip(used, w.tolist(), strict=True))
            nets.append((fold, category, scenario, c, [weight.get(f, 0.0) for f in features]))
    table = panel.sparkSession.createDataFrame(nets, "fold int, category string, scenario string, _c double, _w array<double>")
    tested = _assigned(rows.drop(*targets[1:]), schedule.collect(), purge, day).where("split = 'test'")
    p = F.col("_c")
    scored = tested.join(F.broadcast(table), "fold")  # a row a fold and case
    for i, c in enumerate(features):
        p = p + F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)) * F.col("_w")[i]
    keys = ["category", "scenario", "fold"]
    return metrics.ic_summary(metrics.ic_by_date(scored.withColumn("prediction", p), "prediction", target, keys, day), keys)


def stress_rows(scores: DataFrame) -> DataFrame:
    """(category, scenario, mean_ic, worst_fold_ic, folds) over all folds, with what each scenario gives up against the baseline."""
    by = scores.groupBy("category", "scenario").agg(F.avg("mean_ic").alias("mean_ic"), F.min("mean_ic").alias("worst_fold_ic"), F.count("*").alias("folds"))
    base = by.where("category = 'baseline'").select(F.col("mean_ic").alias("_b"))  # one row
    return by.join(F.broadcast(base), how="left").withColumn("change", F.col("mean_ic") - F.col("_b")).drop("_b")
