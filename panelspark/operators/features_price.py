"""Price features: one exchange by security, one sort, one pass in which every feature slides along the history.

``r`` is the log return of the adjusted close and ``b`` that of the benchmark.  "n rows,
at least m" means the security's last n rows with at least m non-null values.  A feature's
cost does not follow the length of its window (``functions/sliding.py``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import sliding as S
from panelspark.functions.windows import DATE, ID, in_order

YEAR = 252.0
LONGEST = 252
FAMILIES = {
    "momentum": ["reversal_5d", "reversal_21d", "momentum_21d", "momentum_63d", "momentum_126d", "momentum_252d", "momentum_12m_ex1m", "dist_52w_high", "ma_distance_50d", "momentum_consistency_63d", "trend_slope_63d", "trend_r2_63d"],
    "risk": ["volatility_20d", "volatility_60d", "volatility_252d", "downside_vol_60d", "beta_252d", "corr_benchmark_252d", "var_95_252d", "idio_vol_252d", "expected_shortfall_95_252d", "max_drawdown_252d"],
    "liquidity": ["adv_21d", "turnover_21d", "amihud_illiquidity_21d", "zero_return_freq_63d", "volume_surprise_21d", "spread_proxy_21d"],
}


def log_return(x: Column, n: int = 1) -> Column:
    """ln x - ln of x n rows before; null where either is not positive."""
    return F.ln(x) - F.lag(F.ln(x), n).over(in_order())


def with_returns(prices: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """lp, r and, with a benchmark (a row a date, broadcast by size), b."""
    out = prices.withColumn("lp", F.ln("adjusted_close"))
    if benchmark is not None:
        out = out.join(benchmark_returns(benchmark), DATE, "left")
    return out.withColumn("r", F.col("lp") - F.lag("lp").over(in_order()))


def benchmark_returns(benchmark: DataFrame) -> DataFrame:
    """(observation_date, b): log returns of the one benchmark series, a row a session."""
    one = benchmark.select(DATE, F.ln("close").alias("_l"), F.lit(1).alias("_k"))
    return one.withColumn("b", F.col("_l") - F.lag("_l").over(in_order("_k"))).select(DATE, "b")


def _lag(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if n < len(x):
        out[n:] = x[:-n]
    return out


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), np.nan)


def _momentum(h: S.History, x: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    lp, r, price = x["lp"], x["r"], x["adjusted_close"]
    out = {f"reversal_{n}d": _lag(lp, n) - lp for n in (5, 21)}
    out |= {f"momentum_{n}d": lp - _lag(lp, n) for n in (21, 63, 126, 252)}
    out["momentum_12m_ex1m"] = _lag(lp, 21) - _lag(lp, 252)
    out["dist_52w_high"] = lp - _log(S.highest(price, 252, 200))
    out["ma_distance_50d"] = lp - _log(S.mean(price, 50, 40))
    out["momentum_consistency_63d"] = S.mean(np.where(np.isfinite(r), r > 0, np.nan), 63, 50)
    slope, _, r2 = S.regression(lp, np.arange(len(lp), dtype=np.float64), 63, 63)
    out["trend_slope_63d"] = slope / np.maximum(np.abs(lp), 0.1)
    out["trend_r2_63d"] = np.where(np.isfinite(slope), np.clip(np.nan_to_num(r2), 0.0, 1.0), np.nan)
    return out


def _risk(h: S.History, x: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    r, b, price, year, new = x["r"], x["b"], x["adjusted_close"], np.sqrt(YEAR), slice(h.before, None)
    out = {f"volatility_{n}d": S.deviation(r, n, n * 4 // 5) * year for n in (20, 60, 252)}
    out["downside_vol_60d"] = S.deviation(np.where(r < 0, r, np.nan), 60, 20) * year
    beta, corr, _ = S.regression(r, b, 252, 120)
    out |= {"beta_252d": beta, "corr_benchmark_252d": corr}
    # what follows is made of each row's own beta, VaR and peak, which earlier batches passed on
    var = h.tool("var", lambda: S.SlidingQuantile(252, 0.05, 120)).push(r[new])
    rest = h.extended("_rest", r[new] - beta[new] * b[new])
    tail = h.extended("_tail", np.where(r[new] <= var, r[new], np.nan))
    fall = h.extended("_fall", price[new] / S.highest(price, 252, 120)[new] - 1)
    out["var_95_252d"] = np.concatenate([np.full(h.before, np.nan), var])
    out["idio_vol_252d"] = S.deviation(rest, 252, 120) * year
    out["expected_shortfall_95_252d"] = S.mean(tail, 252, 6)
    out["max_drawdown_252d"] = S.lowest(fall, 252, 120)
    return out


def _liquidity(h: S.History, x: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    r, dv, v = x["r"], x["dollar_volume"], x["volume"]
    grown = lambda y: _log(1 + y)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(x["shares_outstanding"] != 0, S.mean(v, 21, 15) / x["shares_outstanding"], np.nan)
        cost = np.abs(r) / (dv + 1)
        spread = (x["high"] - x["low"]) / x["adjusted_close"]
    return {
        "adv_21d": np.log1p(S.mean(dv, 21, 15)),
        "turnover_21d": share,
        "amihud_illiquidity_21d": S.mean(cost, 21, 15) * 1e9,
        "zero_return_freq_63d": S.mean(np.where(np.isfinite(r), np.abs(r) < 1e-8, np.nan), 63, 40),
        "volume_surprise_21d": grown(S.mean(v, 21, 15)) - grown(S.mean(v, 63, 40)),
        "spread_proxy_21d": S.mean(spread, 21, 15),
    }


_MAKERS = {"momentum": _momentum, "risk": _risk, "liquidity": _liquidity}
_NEEDS = {"momentum": ["adjusted_close"], "risk": ["adjusted_close", "b"], "liquidity": ["adjusted_close", "dollar_volume", "volume", "shares_outstanding", "high", "low"]}


def price_features(prices: DataFrame, benchmark: DataFrame | None = None, families: Sequence[str] = ("momentum", "risk", "liquidity"), carry: Sequence[str] = ()) -> DataFrame:
    """(security_id, as_of, features...) for each bar; ``carry`` names input columns to keep.

    Input columns that a family needs and that are absent (shares_outstanding, high, low,
    volume, dollar_volume) are read as null, NaN counts as null too.  Dates after a row never enter its features.
    """
    if "risk" in families and benchmark is None:
        raise ValueError("the risk family needs a benchmark")
    df = prices
    if "risk" in families:
        df = df.drop("b").join(benchmark_returns(benchmark), DATE, "left")
    needed = list(dict.fromkeys(c for f in families for c in _NEEDS[f]))
    present = [c for c in needed if c in df.columns]
    names = [f for family in families for f in FAMILIES[family]]

    def make(h: S.History, part: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        rows = len(part["adjusted_close"])
        before = h.before
        x = {c: h.extended(c, part[c] if c in part else np.full(rows, np.nan)) for c in needed}
        x["lp"] = _log(x["adjusted_close"])
        x["r"] = h.extended("r", (x["lp"] - _lag(x["lp"], 1))[before:])
        out: dict[str, np.ndarray] = {}
        for f in families:
            out |= _MAKERS[f](h, x)
        return {c: out[c][before:] for c in names}

    out = S.streamed(df, ID, DATE, present, list(dict.fromkeys([ID, DATE, *carry])), ", ".join(f"{c} double" for c in names), LONGEST, make)
    return out.select(ID, F.col(DATE).alias("as_of"), *carry, *names)
