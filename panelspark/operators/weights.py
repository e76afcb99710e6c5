"""Portfolio weights by date: construction, capped allocation without a loop, audits and turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.windows import ID

RANK = "cross_sectional_rank"


def _day() -> WindowSpec:
    return Window.partitionBy("as_of")


def eligible(candidates: DataFrame, restricted: DataFrame | None = None, least_names: int = 1) -> DataFrame:
    """Candidates without restricted names; ``feasible`` is false on dates with too few of them."""
    df = candidates.where(F.col(RANK).isNotNull())
    if restricted is not None:
        df = df.join(restricted.select(ID), ID, "left_anti")
    return df.withColumn("feasible", F.count("*").over(_day()) >= least_names)


def top(candidates: DataFrame, k: int, by: str = RANK) -> DataFrame:
    """The k best of each date; ties fall to the smaller id."""
    w = Window.partitionBy("as_of").orderBy(F.col(by).desc_nulls_last(), ID)
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def preselected(candidates: DataFrame, most_holdings: int, covered: DataFrame | None = None) -> DataFrame:
    """The top max(4 * holdings, 200) among covered names."""
    df = candidates if covered is None else candidates.join(covered.select(ID).distinct(), ID, "left_semi")
    return top(df, max(4 * most_holdings, 200))


def capped(scores: DataFrame, cap: float, floor: float = 0.0, budget: float = 1.0, score: str = "score") -> DataFrame:
    """``weight``: ``floor`` each, the rest in proportion to the score, none above ``cap``, the excess handed on.

    The fixed point without a loop: with names sorted by score, descending, the first j are
    at the cap, and the others share what is left in proportion; j is the least number for
    which the next name stays below its cap.  If all names at the cap do not reach the
    budget, all are at the cap.  Negative and null scores count as zero; all-zero scores share evenly.
    """
    s = F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    df = scores.withColumn("_s", s)
    df = df.withColumn("_s", F.when(F.sum("_s").over(_day()) > 0, F.col("_s")).otherwise(F.lit(1.0)))
    order = Window.partitionBy("as_of").orderBy(F.col("_s").desc(), ID)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({"_n": F.count("*").over(_day()), "_j": F.row_number().over(order) - 1, "_rest": F.sum("_s").over(onward), "_before": F.coalesce(F.sum("_s").over(before), F.lit(0.0))})
    room, part = F.lit(cap - floor), F.lit(budget) - floor * F.col("_n")
    share = F.try_divide(part - F.col("_j") * room, F.col("_rest"))  # weight for one unit of score if the names before are capped
    df = df.withColumn("_u", F.when((F.col("_s") * share <= room) & (F.col("_rest") > 0), F.struct("_j", share.alias("share"))))
    df = df.withColumn("_u", F.min("_u").over(_day()))
    extra = F.when(F.col("_u").isNull() | (F.col("_j") < F.col("_u._j")), room).otherwise(F.col("_s") * F.col("_u.share"))
    return df.withColumn("weight", floor + F.greatest(extra, F.lit(0.0))).select(*scores.columns, "weight")


def equal_weight(candidates: DataFrame, n: int, cap: float = 1.0, budget: float = 1.0) -> DataFrame:
    """The top n names at min(budget / n held, cap) each."""
    held = top(candidates, n)
    return held.withColumn("weight", F.least(F.lit(budget) / F.count("*").over(_day()), F.lit(cap))).select("as_of", ID, "weight")


def score_weight(candidates: DataFrame, n: int, cap: float, floor: float = 0.0, budget: float = 1.0, shape: str = "linear", power: float = 2.0, temperature: float = 0.1) -> DataFrame:
    """The top n names by their rank above the weakest: ``linear``, ``power`` or ``softmax``."""
    held = top(candidates, n)
    up = F.col(RANK) - F.min(RANK).over(_day())
    score = {"linear": up + 1e-6, "power": F.pow(up + 1e-6, F.lit(power)), "softmax": F.exp((F.col(RANK) - F.max(RANK).over(_day())) / temperature)}[shape]
    return capped(held.withColumn("score", score), cap, floor, budget).select("as_of", ID, "weight")


def inverse_volatility(candidates: DataFrame, n: int, cap: float, floor: float = 0.0, budget: float = 1.0, volatility: str = "volatility_60d") -> DataFrame:
    """The top n names by 1 / volatility; missing and non-positive volatilities take the date's median."""
    held = top(candidates, n)
    v = F.when(F.col(volatility) > 0, F.col(volatility))
    held = held.withColumn("_v", F.coalesce(v, F.median(v).over(_day()), F.lit(1.0)))
    return capped(held.withColumn("score", 1 / F.col("_v")), cap, floor, budget).select("as_of", ID, "weight")


def audit(weights: DataFrame, cap: float, floor: float, most_names: int, budget: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """(as_of, n_names, total, smallest, largest, violations): long only, cap, floor, count, budget, fully invested."""
    held = F.col("weight") > tolerance
    by = weights.groupBy("as_of").agg(F.count_if(held).alias("n_names"), F.sum("weight").alias("total"), F.min("weight").alias("smallest"), F.max("weight").alias("largest"), F.min(F.when(held, F.col("weight"))).alias("_held"))
    rules = {
        "short": F.col("smallest") < -tolerance, "over_cap": F.col("largest") > cap + tolerance, "under_floor": F.col("_held") < floor - tolerance,
        "too_many": F.col("n_names") > most_names, "over_budget": F.col("total") > budget + tolerance, "not_invested": F.col("total") < budget - 1e-3,
    }
    return by.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).drop("_held")


def with_previous(weights: DataFrame) -> DataFrame:
    """(as_of, security_id, weight, previous) over the union of names of consecutive dates."""
    dates = weights.select("as_of").distinct().withColumn("_next", F.lead("as_of").over(Window.orderBy("as_of")))  # a row a rebalance
    now = weights.select("as_of", ID, "weight")
    was = weights.join(F.broadcast(dates), "as_of").where("_next IS NOT NULL").select(F.col("_next").alias("as_of"), ID, F.col("weight").alias("previous"))
    both = now.join(was, ["as_of", ID], "full_outer")
    zero = F.lit(0.0)
    return both.select("as_of", ID, F.coalesce("weight", zero).alias("weight"), F.coalesce("previous", zero).alias("previous"))


def turnover(weights: DataFrame) -> DataFrame:
    """(as_of, turnover): half the sum of absolute weight changes; the first date trades in from cash."""
    return with_previous(weights).groupBy("as_of").agg((F.sum(F.abs(F.col("weight") - F.col("previous"))) / 2).alias("turnover"))


def universe_sector_weights(universe: DataFrame) -> DataFrame:
    """(as_of, sector, weight): equal weight by count."""
    by = universe.groupBy("as_of", "sector").agg(F.count("*").alias("_c"))
    return by.select("as_of", "sector", (F.col("_c") / F.sum("_c").over(_day())).alias("weight"))


def binding(weights: DataFrame, betas: DataFrame, cap: float, beta_low: float, beta_high: float, most_turnover: float, tolerance: float = 1e-4) -> DataFrame:
    """(as_of, at_cap, beta, turnover, binding): which limits a weight table sits at."""
    b = betas.select(ID, "beta")
    by = weights.join(b, ID, "left").groupBy("as_of").agg(F.count_if(F.col("weight") >= cap - tolerance).alias("at_cap"), F.sum(F.col("weight") * F.coalesce("beta", F.lit(1.0))).alias("beta"))
    by = by.join(turnover(weights), "as_of")
    rules = {"cap": F.col("at_cap") > 0, "beta_low": F.col("beta") <= beta_low + tolerance, "beta_high": F.col("beta") >= beta_high - tolerance, "turnover": F.col("turnover") >= most_turnover - tolerance}
    return by.withColumn("binding", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def sector_deviation(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """(as_of, sector, weight, benchmark_weight, deviation)."""
    sector = universe.select("as_of", ID, "sector")
    own = weights.join(sector, ["as_of", ID], "left").groupBy("as_of", "sector").agg(F.sum("weight").alias("weight"))
    ref = universe_sector_weights(universe).withColumnRenamed("weight", "benchmark_weight")
    out = own.withColumnRenamed("sector", "_s").join(ref, (own["as_of"] == ref["as_of"]) & F.col("_s").eqNullSafe(ref["sector"]), "full_outer")
    w, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("benchmark_weight", F.lit(0.0))
    return out.select(F.coalesce(own["as_of"], ref["as_of"]).alias("as_of"), F.coalesce("_s", "sector").alias("sector"), w.alias("weight"), b.alias("benchmark_weight"), (w - b).alias("deviation"))


def adv_limit(weights: DataFrame, adv: DataFrame, value: float, most_share: float) -> DataFrame:
    """Positions larger than a share of average daily volume: (as_of, security_id, weight, adv, adv_share)."""
    share: Column = F.try_divide(F.col("weight") * value, F.col("adv"))
    return weights.join(adv.select("as_of", ID, "adv"), ["as_of", ID], "left").withColumn("adv_share", share).where(F.col("adv_share").isNull() | (F.col("adv_share") > most_share))
