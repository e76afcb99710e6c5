"""Models on pyspark.ml: guarded fits, scoring with ranks, baselines, ensembles, a bounded search."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clean
from panelspark.functions.windows import ID, average_rank
from panelspark.operators.metrics import ic_by_date
from panelspark.operators.preprocess import apply, fit
from panelspark.sources.shared import written

KEY = [ID, "as_of"]


def seed_of(*identity: object) -> int:
    """A stable seed for a task's identity."""
    return int(hashlib.sha256("|".join(map(str, identity)).encode()).hexdigest()[:7], 16)


def training_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with all features and the target present and finite; refuses a target among the features and an empty result."""
    if target in features:
        raise ValueError("the target is among the features")
    if lacking := [c for c in (*features, target) if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    fine = None
    for c in (*features, target):
        x = F.col(c).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        fine = ok if fine is None else fine & ok
    out = df.where(fine)
    if not out.limit(1).count():
        raise ValueError("no complete training row")
    return out


def ranked(scores: DataFrame, day: str = "as_of") -> DataFrame:
    """``cross_sectional_rank``: average rank / n of the prediction by date."""
    w = Window.partitionBy(day)
    return scores.withColumn("cross_sectional_rank", average_rank(F.col("prediction"), day) / F.count("prediction").over(w))


@dataclass
class Fitted:
    """A fitted pipeline with what it was fitted on."""

    model: PipelineModel
    features: list[str]
    target: str
    info: dict[str, Any] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """(security_id, as_of, prediction, cross_sectional_rank); missing features count as 0, absent columns are refused."""
        if lacking := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"the schema drifted, missing: {', '.join(lacking)}")
        rows = df.withColumns({c: F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)) for c in self.features})
        out = self.model.transform(rows)
        p = vector_to_array("probability")[1] if self.info.get("classifier") else F.col("prediction")
        return ranked(out.select(*KEY, p.cast("double").alias("prediction")))

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance) scaled to one: tree importances or absolute coefficients."""
        last = self.model.stages[-1]
        raw = [abs(x) for x in (last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray())]
        total = sum(raw) or 1.0
        return spark.createDataFrame([(f, float(v) / total) for f, v in zip(self.features, raw, strict=True)], "feature string, importance double")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, self.model.stages[-1].coefficients.toArray(), strict=True)], "feature string, coefficient double")


def _fit(train: DataFrame, features: Sequence[str], target: str, estimator, **info) -> Fitted:
    rows = training_rows(train, features, target)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    return Fitted(Pipeline(stages=[assembler, estimator]).fit(rows), list(features), target, info)


def elastic_net(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1e-3, l1_ratio: float = 0.5) -> Fitted:
    """Least squares with alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2) over unscaled features.

    The learner divides the quadratic part by the target's deviation; the parameters are mapped for that.
    """
    sd = training_rows(train, features, target).agg(F.stddev_pop(target)).first()[0] or 1.0
    reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * sd
    est = LinearRegression(featuresCol="_x", labelCol=target, standardization=False, regParam=reg, elasticNetParam=alpha * l1_ratio / reg if reg else 0.0, maxIter=500, tol=1e-10)
    out = _fit(train, features, target, est)
    out.info["selected"] = int(sum(abs(c) > 1e-12 for c in out.model.stages[-1].coefficients.toArray()))
    return out


def logistic(train: DataFrame, features: Sequence[str], target: str = "outperform", c: float = 1.0) -> Fitted:
    """Probability that the target is over one half; refuses a single class."""
    rows = training_rows(train, features, target).withColumn("_y", (F.col(target) > 0.5).cast("double"))
    n, up = rows.agg(F.count("*"), F.sum("_y")).first()
    if up in (0, n):
        raise ValueError("one class only")
    est = LogisticRegression(featuresCol="_x", labelCol="_y", standardization=False, regParam=1 / (c * n), maxIter=500, tol=1e-10)
    return _fit(rows, features, "_y", est, classifier=True)


def boosted(train: DataFrame, features: Sequence[str], target: str, validation: DataFrame | None = None, seed: int = 7, trees: int = 50, depth: int = 3, rate: float = 0.1, subsample: float = 0.8) -> Fitted:
    """Shallow boosted trees, stopped early on validation rows if given."""
    est = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed)
    rows = training_rows(train, features, target)
    if validation is not None:
        cols = [*features, target]
        rows = rows.select(*cols, F.lit(False).alias("_v")).unionByName(training_rows(validation, features, target).select(*cols, F.lit(True).alias("_v")))
        est = est.setValidationIndicatorCol("_v")
    return _fit(rows, features, target, est)


def forest(train: DataFrame, features: Sequence[str], target: str, seed: int = 7, trees: int = 100, depth: int = 5, leaf: int = 50) -> Fitted:
    """Random forest, for diagnosis only."""
    est = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return _fit(train, features, target, est, diagnostic=True)


def no_skill(train: DataFrame, df: DataFrame, target: str) -> DataFrame:
    """The training mean for every row."""
    one = train.agg(F.avg(target).alias("prediction"))
    return ranked(df.select(*KEY).crossJoin(F.broadcast(one)))


def single_column(df: DataFrame, column: str = "momentum_12m_ex1m") -> DataFrame:
    return ranked(df.select(*KEY, F.coalesce(clean(F.col(column)), F.lit(0.0)).alias("prediction")))


# Pillars with their weights and signed factors.
PILLARS: Mapping[str, tuple[float, Mapping[str, int]]] = {
    "momentum": (0.30, {"momentum_12m_ex1m": 1, "momentum_126d": 1}),
    "trend": (0.15, {"dist_52w_high": 1, "trend_slope_63d": 1}),
    "risk": (0.25, {"volatility_60d": -1, "beta_252d": -1}),
    "reversal": (0.10, {"reversal_21d": 1}),
    "value": (0.20, {"earnings_yield": 1, "book_to_market": 1}),
}


def effective_weights(columns: Sequence[str], pillars: Mapping[str, tuple[float, Mapping[str, int]]] = PILLARS) -> dict[str, float]:
    """Signed weight of each factor present: pillars that have any are scaled to one and share evenly among their factors."""
    have = {p: [f for f in fs if f in columns] for p, (_, fs) in pillars.items()}
    total = sum(pillars[p][0] for p, fs in have.items() if fs)
    return {f: pillars[p][1][f] * pillars[p][0] / total / len(fs) for p, fs in have.items() for f in fs}


def factor_composite(df: DataFrame, pillars: Mapping[str, tuple[float, Mapping[str, int]]] = PILLARS) -> DataFrame:
    """The weighted sum of signed factors (preprocessed ones are best), missing values as 0."""
    w = effective_weights(df.columns, pillars)
    score = F.lit(0.0)
    for f, x in w.items():
        score = score + F.coalesce(clean(F.col(f)), F.lit(0.0)) * x
    return ranked(df.select(*KEY, score.alias("prediction")))


def coefficient_stability(long: DataFrame) -> DataFrame:
    """(feature, mean, sd, sign_consistency, share_nonzero) of (fold, feature, coefficient)."""
    c = F.col("coefficient")
    return long.groupBy("feature").agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), (F.abs(F.sum(F.signum(c))) / F.count(c)).alias("sign_consistency"), F.avg((F.abs(c) > 1e-12).cast("double")).alias("share_nonzero"))


def mean_ic(scores: DataFrame, labels: DataFrame, realised: str = "excess_return", least: int = 5) -> float | None:
    rows = ic_by_date(scores.join(labels.select(*KEY, realised), KEY), "prediction", realised, least=least)
    return rows.agg(F.avg("ic")).first()[0]


def bounded_search(train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, grid: Sequence[Mapping[str, Any]], most_trials: int = 8, seed: int = 7) -> tuple[Fitted, list[dict]]:
    """The boosted model of the best validation IC among a few settings, and all trials."""
    trials, best = [], None
    for i, params in enumerate(list(grid)[:most_trials]):
        m = boosted(train, features, target, validation, seed=seed_of(seed, i), **params)
        ic = mean_ic(m.predict(validation), validation, target)
        trials.append({"trial": i, "params": dict(params), "validation_ic": ic})
        if best is None or (ic if ic is not None else -2) > best[0]:
            best = (ic if ic is not None else -2, m)
    return best[1], trials


def ensemble_weights(ic: Mapping[str, float], floor: float = 0.05, cap: float = 0.6, previous: Mapping[str, float] | None = None, smoothing: float = 0.0, is_holdout: bool = False) -> dict[str, float]:
    """Weights by positive validation IC, scaled in proportion within floor and cap, smoothed with the previous ones.

    Holdout ICs are refused, and so is a cap that the members cannot add up to one under.
    """
    if is_holdout:
        raise PermissionError("ensemble weights must not use the holdout")
    names = sorted(ic)
    w = {n: max(ic[n] or 0.0, 0.0) for n in names}
    total = sum(w.values())
    w = {n: w[n] / total if total else 1 / len(names) for n in names}
    if cap * len(names) < 1 - 1e-9:
        raise ValueError(f"{len(names)} members of at most {cap} each do not add up to one")
    low = min(floor, 1 / len(names))

    def held(x: dict[str, float]) -> dict[str, float]:
        return {n: min(max(v, low), cap) for n, v in x.items()}

    # bounds and scaling in turn; both hold where the sum of the bounded weights is one
    w = held(w)
    for _ in range(100):
        total = sum(w.values())
        if abs(total - 1) < 1e-12:
            break
        w = held({n: x / total for n, x in w.items()})
    total = sum(w.values())
    w = {n: x / total for n, x in w.items()}
    if previous:
        w = {n: (1 - smoothing) * w[n] + smoothing * previous.get(n, w[n]) for n in names}
        total = sum(w.values())
        w = {n: x / total for n, x in w.items()}
    return w


def ensemble_score(members: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """The weighted sum of members' ranks over names that all members cover; ``members`` is long (model, security_id, as_of, cross_sectional_rank)."""
    spark = members.sparkSession
    w = spark.createDataFrame(list(weights.items()), "model string, _w double")
    by = members.join(F.broadcast(w), "model").groupBy(*KEY).agg(F.sum(F.col("_w") * F.col("cross_sectional_rank")).alias("prediction"), F.count("*").alias("_n"))
    return ranked(by.where(F.col("_n") == len(weights)).drop("_n"))


def disagreement(members: DataFrame) -> DataFrame:
    """One row: 1 - the mean pairwise rank correlation of members over dates."""
    a = members.select(*KEY, F.col("model").alias("m1"), F.col("cross_sectional_rank").alias("r1"))
    b = members.select(*KEY, F.col("model").alias("m2"), F.col("cross_sectional_rank").alias("r2"))
    by = a.join(b, KEY).where("m1 < m2").groupBy("m1", "m2", "as_of").agg(F.corr("r1", "r2").alias("c"))
    return by.agg((1 - F.avg("c")).alias("disagreement"))


def blended_importance(importances: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, importance): members' importances times their weights."""
    return importances.join(F.broadcast(weights), "model").groupBy("feature").agg(F.sum(F.col("importance") * F.col("weight")).alias("importance"))


FITTERS = {"elastic_net": elastic_net, "boosted": boosted, "forest": forest}


def run_folds(panel: DataFrame, features: Sequence[str], target: str, models: Sequence[str] = ("elastic_net",), how: str = "rank", run_id: str = "run") -> DataFrame:
    """Predictions (model, fold, split, security_id, as_of, prediction, cross_sectional_rank) of every model on every fold's validation and test rows.

    The (model, fold) list is short; each fit and each transform is a distributed job.
    Preprocessing is fitted on the fold's training rows.
    """
    out = None
    # read once a fold and model, so it is not worked out anew each time
    panel = written(panel.select(*KEY, "fold", "split", *features, target), "folds")
    for fold in sorted(r["fold"] for r in panel.select("fold").distinct().collect()):  # a row a fold
        part = panel.where(F.col("fold") == fold)
        train = part.where("split = 'train'")
        stats = fit(train, features)
        ready = written(apply(part, stats, features, how, flags=False), "ready")
        for name in models:
            kw = {} if name == "elastic_net" else {"seed": seed_of(run_id, name, fold)}
            m = FITTERS[name](ready.where("split = 'train'"), features, target, **kw)
            rest = ready.where("split <> 'train'")
            p = m.predict(rest).join(rest.select(*KEY, "split"), KEY).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "split", *KEY, "prediction", "cross_sectional_rank")
            p = written(p, "predictions")
            out = p if out is None else out.unionByName(p)
    if out is None:
        return panel.sparkSession.createDataFrame([], f"model string, fold int, split string, {ID} string, as_of date, prediction double, cross_sectional_rank double")
    return out


def latest_executable(panel: DataFrame, cal: DataFrame, today, delay: int = 1, most_age_days: int = 7) -> DataFrame:
    """Rows of the newest signal date whose delayed fill exists in the calendar; stale data are refused."""
    cut = cal.agg(F.max("idx").alias("_m"))
    ok = cal.join(F.broadcast(cut), F.col("idx") <= F.col("_m") - delay).select(F.col("session").alias("as_of"))
    last = panel.join(F.broadcast(ok), "as_of", "left_semi").agg(F.max("as_of").alias("d"), F.datediff(F.lit(today).cast("date"), F.max("as_of")).alias("age")).first()
    if last["d"] is None or last["age"] > most_age_days:
        raise ValueError(f"the newest signal is stale: {last['d']}")
    return panel.where(F.col("as_of") == F.lit(last["d"]))
