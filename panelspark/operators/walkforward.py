"""Linear walk-forward fits from moments: every fold of an expanding schedule out of one pass over the panel.

A linear model needs the number, sums and products of its training rows and nothing else.
The training set of a fold is a prefix of the panel less two slices: rows within the embargo
before its validation, and rows whose label window reaches the validation.  So one pass sums
moments by step of the schedule (the rows between two validation starts) and by slice; a
fold's moments are the steps up to it less its slice.  No row is copied for a fold, and a
fold more costs one small matrix.  Fits run on matrices of features by features.

Moments are those of values less the panel's means, so that levels do not drown variances.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clean
from panelspark.functions.windows import ID, average_rank
from panelspark.operators.splits import with_embargo
from panelspark.sources.shared import written

STEP, CUT = 0, 1
KEY = [ID, "as_of"]


@dataclass(frozen=True)
class Fold:
    """Moments of a fold's training rows about ``shift``: number, means and covariance of the features and the target (last)."""

    fold: int
    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """Standard deviations of the features; one where a feature does not vary."""
        sd = np.sqrt(np.maximum(np.diag(self.cov)[:-1], 0))
        return np.where(sd > 1e-12, sd, 1.0)


def _parts(schedule: list, day: str, purge: bool) -> Column:
    """(kind, fold) of each part that a row counts in: its step, and the slices of folds that it is kept out of."""
    at, until = F.col(day), F.col("window_end")
    starts = [r["validation_start"] for r in schedule]
    step = sum(((at >= F.lit(v)).cast("int") for v in starts), F.lit(0))
    own = F.when(step < len(starts), F.struct(F.lit(STEP).alias("kind"), step.alias("i")))
    cuts = []
    for i, r in enumerate(schedule):
        late = at >= F.lit(r["_last"])
        if purge:
            late |= F.coalesce(until >= F.lit(r["validation_start"]), F.lit(False))
        cuts.append(F.when((at < F.lit(r["validation_start"])) & late, F.struct(F.lit(CUT).alias("kind"), F.lit(i).alias("i"))))
    return F.filter(F.array(own, *cuts), lambda x: x.isNotNull())


def moments(panel: DataFrame, features: Sequence[str], target: str, schedule: DataFrame, cal: DataFrame | None = None, embargo: int = 0, purge: bool = True, day: str = "as_of") -> tuple[list[Fold], np.ndarray]:
    """The training moments of every fold, and the shift that they are about; rows with a missing or non-finite value do not count.

    What comes to the driver is two matrices a fold.
    """
    if target in features:
        raise ValueError("the target is among the features")
    names = [*features, target]
    rows = with_embargo(schedule, cal, embargo).orderBy("validation_start").collect()  # a row a fold
    if len({r["train_start"] for r in rows}) > 1:
        raise ValueError("training windows must expand from one start")
    if not rows:
        return [], np.zeros(len(names))
    x = [clean(F.col(c).cast("double")) for c in names]
    inside = panel.where((F.col(day) >= F.lit(rows[0]["train_start"])) & (F.col(day) < F.lit(rows[-1]["validation_start"])))
    shift = np.array([v or 0.0 for v in inside.agg(*[F.avg(c) for c in x]).first()])
    size = len(names) + 1
    pick = np.triu_indices(size)
    of = len(rows)

    def run(batches: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.ones((len(b), size))
            for i in range(size - 1):
                z[:, i + 1] = b.column(i + 1).to_numpy(zero_copy_only=False) - shift[i]  # null becomes NaN
            parts = b.column(0)
            row = np.repeat(np.arange(len(b)), parts.value_lengths().to_numpy())
            flat = parts.flatten()
            key = flat.field(0).to_numpy() * of + flat.field(1).to_numpy()
            fine = np.isfinite(z).all(axis=1)[row]
            for k in np.unique(key[fine]).tolist():
                part = z[row[fine & (key == k)]]
                sums[k] = sums.get(k, 0) + part.T @ part
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k][pick] for k in keys], pa.list_(pa.float64()))], ["k", "z"])

    made = inside.select(_parts(rows, day, purge).alias("p"), *[c.alias(f"_{i}") for i, c in enumerate(x)]).mapInArrow(run, "k int, z array<double>")
    total = np.zeros((2 * of, size, size))
    for r in made.select("k", F.posexplode("z").alias("i", "z")).groupBy("k", "i").agg(F.sum("z").alias("z")).collect():
        a, b = pick[0][r["i"]], pick[1][r["i"]]
        total[r["k"], a, b] = total[r["k"], b, a] = r["z"]
    steps, cuts = np.cumsum(total[:of], axis=0), total[of:]
    out = []
    for i, r in enumerate(rows):
        t = steps[i] - cuts[i]
        n = round(t[0, 0])
        if n <= 0:
            raise ValueError(f"no complete training row in fold {r['fold']}")
        mean = t[0, 1:] / n
        out.append(Fold(r["fold"], n, mean, t[1:, 1:] / n - np.outer(mean, mean)))
    return out, shift


def descent(g: np.ndarray, b: np.ndarray, l1: float, l2: float, most: int = 100_000, tol: float = 1e-13) -> np.ndarray:
    """w that minimises w'gw / 2 - b'w + l1 |w| + l2 w'w / 2, by coordinate descent; least squares of least norm without penalties."""
    if not l1 and not l2:
        return np.linalg.lstsq(g, b, rcond=None)[0]
    w = np.zeros(len(b))
    scale = max(1e-300, float(np.abs(b).max(initial=0)) / max(1e-300, float(np.diag(g).max(initial=0))))
    for _ in range(most):
        change = 0.0
        for j in range(len(b)):
            z = b[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(z) * max(abs(z) - l1, 0.0) / (g[j, j] + l2) if g[j, j] + l2 > 0 else 0.0
            change = max(change, abs(new - w[j]))
            w[j] = new
        if change <= tol * scale:
            break
    return w


def elastic_nets(folds: list[Fold], shift: np.ndarray, alpha: float = 1e-3, l1_ratio: float = 0.5, scaled: bool = False) -> list[tuple[int, int, float, np.ndarray]]:
    """(fold, training rows, intercept, coefficients) of |y - c - Xw|^2 / 2n + alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2).

    ``scaled`` penalises the coefficients of features divided by their training deviation; the ones returned are of the features as they are.
    """
    out = []
    for f in folds:
        s = f.scale if scaled else np.ones(len(f.mean) - 1)
        w = descent(f.cov[:-1, :-1] / np.outer(s, s), f.cov[:-1, -1] / s, alpha * l1_ratio, alpha * (1 - l1_ratio)) / s
        out.append((f.fold, f.n, float(shift[-1] + f.mean[-1] - w @ (shift[:-1] + f.mean[:-1])), w))
    return out


def _assigned(panel: DataFrame, schedule: list, purge: bool, day: str) -> DataFrame:
    """The panel with the (fold, split) in which a row is predicted: validation rows whose window ends before the test, and test rows."""
    at, until = F.col(day), F.col("window_end")
    each = []
    for r in schedule:
        safe = F.coalesce(until < F.lit(r["test_start"]), F.lit(True)) if purge else F.lit(True)
        split = F.when((at >= F.lit(r["validation_start"])) & (at < F.lit(r["validation_end"])), F.when(safe, "validation")).when((at >= F.lit(r["test_start"])) & (at < F.lit(r["test_end"])), "test")
        each.append(F.when(split.isNotNull(), F.struct(F.lit(r["fold"]).alias("fold"), split.alias("split"))))
    return panel.withColumn("_p", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))).select(*panel.columns, "_p.fold", "_p.split")


def walk_forward(panel: DataFrame, features: Sequence[str], target: str, schedule: DataFrame, cal: DataFrame | None = None, embargo: int = 0, purge: bool = True, alpha: float = 1e-3, l1_ratio: float = 0.5, scaled: bool = False, day: str = "as_of") -> tuple[DataFrame, DataFrame]:
    """((fold, n_train, intercept, feature, coefficient), predictions) of elastic nets on all folds.

    Predictions are (fold, split, security_id, as_of, target, prediction, cross_sectional_rank)
    of validation and test rows; a missing feature counts as 0 there.  Features must not
    depend on the fold: by-date ranks do not, and ``scaled`` fits deviations on the training rows.
    """
    spark = panel.sparkSession
    panel = written(panel.select(*KEY, "window_end", *features, target), "panel")
    folds, shift = moments(panel, features, target, schedule, cal, embargo, purge, day)
    nets = elastic_nets(folds, shift, alpha, l1_ratio, scaled)
    rows = [(f, n, c, name, float(v)) for f, n, c, w in nets for name, v in zip(features, w, strict=True)]
    table = spark.createDataFrame(rows, "fold int, n_train long, intercept double, feature string, coefficient double")
    fitted = spark.createDataFrame([(f, c, w.tolist()) for f, _, c, w in nets], "fold int, _c double, _w array<double>")
    scored = _assigned(panel, schedule.collect(), purge, day).join(F.broadcast(fitted), "fold")  # a row a fold
    p = F.col("_c")
    for i, c in enumerate(features):
        p = p + F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)) * F.col("_w")[i]
    scored = scored.select("fold", "split", *KEY, target, p.alias("prediction"))
    n = F.count("prediction").over(Window.partitionBy("fold", day))
    return table, scored.withColumn("cross_sectional_rank", average_rank(F.col("prediction"), "fold", day) / n)
