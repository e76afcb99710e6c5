"""Trailing windows over long histories at a cost that does not follow the window's length.

Rows come sorted by key and order, in batches; a key's last rows are carried from batch to
batch, so memory is one batch and one window.  Within a batch everything is vectorised:

- Sums and extremes over n rows are made of a running one since the last multiple of n rows
  and one backwards from it, so nothing is ever subtracted that was added before.
- Central moments are of values less the first one of the batch.  Where what is left of a window's
  squares is a millionth of them or less, the window is worked out by itself.
- Quantiles come from a sorted array of the window, which a row enters and leaves by binary
  search.

Missing values are NaN here and null outside.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

GUARD = 1e-6
CHUNK = 1 << 20  # numbers of windows that are worked out by themselves


def _blocks(x: np.ndarray, n: int, run: np.ufunc, fill: float) -> np.ndarray:
    """``run`` over the last n values (all there are before that)."""
    size = len(x)
    padded = np.full(-(-size // n) * n, fill)
    padded[:size] = x
    y = padded.reshape(-1, n)
    out = run.accumulate(y, axis=1).ravel()[:size].copy()
    back = run.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    t = np.arange(n, size)
    t = t[(t + 1) % n != 0]  # windows that begin in the block before
    out[t] = run(out[t], back[t - n + 1])
    return out


def count(x: np.ndarray, n: int) -> np.ndarray:
    return _blocks(np.isfinite(x).astype(np.float64), n, np.add, 0.0)


def _least(value: np.ndarray, have: np.ndarray, least: int) -> np.ndarray:
    return np.where(have >= max(least, 1), value, np.nan)


def mean(x: np.ndarray, n: int, least: int) -> np.ndarray:
    have = count(x, n)
    return _least(_blocks(np.where(np.isfinite(x), x, 0.0), n, np.add, 0.0) / np.maximum(have, 1), have, least)


def highest(x: np.ndarray, n: int, least: int) -> np.ndarray:
    return _least(_blocks(np.where(np.isfinite(x), x, -np.inf), n, np.maximum, -np.inf), count(x, n), least)


def lowest(x: np.ndarray, n: int, least: int) -> np.ndarray:
    return -highest(-x, n, least)


def covariances(y: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with both, sum of squares of y, of x, and of products) about the means of each window."""
    both = np.isfinite(y) & np.isfinite(x)
    have = _blocks(both.astype(np.float64), n, np.add, 0.0)
    if not both.any():
        return have, *np.zeros((3, len(x)))
    first = both.argmax()  # no later value may shift an earlier window
    a, b = (np.where(both, v - v[first], 0.0) for v in (y, x))
    s, m = lambda v: _blocks(v, n, np.add, 0.0), np.maximum(have, 1)
    sa, sb, qa, qb = s(a), s(b), s(a * a), s(b * b)
    va, vb, c = qa - sa * sa / m, qb - sb * sb / m, s(a * b) - sa * sb / m
    doubt = np.flatnonzero((have > 1) & ((va <= GUARD * qa) & (qa > 0) | (vb <= GUARD * qb) & (qb > 0)))
    for lo in range(0, len(doubt), max(1, CHUNK // n)):
        t = doubt[lo : lo + max(1, CHUNK // n)]
        at = t[:, None] - np.arange(n)[::-1]
        ok = (at >= 0) & both[np.maximum(at, 0)]
        at = np.where(ok, at, 0)
        begin = ok.argmax(axis=1)[:, None]
        # less a value of the window first, so that equal values leave exactly nothing
        u, v = (np.where(ok, w[at] - np.take_along_axis(w[at], begin, 1), 0.0) for w in (y, x))
        u, v = (np.where(ok, w - w.sum(axis=1, keepdims=True) / have[t][:, None], 0.0) for w in (u, v))
        va[t], vb[t], c[t] = (u * u).sum(axis=1), (v * v).sum(axis=1), (u * v).sum(axis=1)
    return have, np.maximum(va, 0), np.maximum(vb, 0), c


def deviation(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """Sample standard deviation."""
    have, v, _, _ = covariances(x, x, n)
    return _least(np.sqrt(v / np.maximum(have - 1, 1)), have, max(least, 2))


def regression(y: np.ndarray, x: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope of y on x, correlation and R squared over rows with both; R squared is one where y does not vary."""
    have, vy, vx, c = covariances(y, x, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(vx > 0, c / vx, np.nan)
        r = np.where((vx > 0) & (vy > 0), np.clip(c / np.sqrt(vx) / np.sqrt(vy), -1, 1), np.nan)
        r2 = np.where(vx > 0, np.where(vy > 0, r * r, 1.0), np.nan)
    return _least(slope, have, least), _least(r, have, least), _least(r2, have, least)


class SlidingQuantile:
    """The linear quantile q of the last n values that come, of which ``least`` must not be missing."""

    def __init__(self, n: int, q: float, least: int):
        self.n, self.q, self.least = n, q, least
        self.sorted: list[float] = []
        self.last: list[float] = []  # the window in order of time

    def push(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        held, q, least = self.sorted, self.q, max(self.least, 1)
        every = self.last + x.tolist()
        gone = len(self.last) - self.n
        for i, v in enumerate(x.tolist()):
            if v == v:
                insort(held, v)
            if gone + i >= 0 and (old := every[gone + i]) == old:
                del held[bisect_left(held, old)]
            m = len(held)
            if m >= least:
                at = q * (m - 1)
                k = int(at)
                out[i] = held[k] if at == k else (k + 1 - at) * held[k] + (at - k) * held[k + 1]
        self.last = every[-self.n :]
        return out


class History:
    """The series of one key: each is extended by a batch's rows behind the last ``most`` ones before."""

    def __init__(self, most: int):
        self.most, self.held, self.tools = most, {}, {}
        self.before = 0  # rows carried into this batch
        self.rows = 0  # rows of all batches before

    def extended(self, name: str, x: np.ndarray) -> np.ndarray:
        old = self.held.get(name)
        whole = x if old is None else np.concatenate([old, x])
        self.held[name] = whole[-self.most :]
        return whole

    def tool(self, name: str, make: Callable):
        if name not in self.tools:
            self.tools[name] = make()
        return self.tools[name]

    def ended(self, rows: int) -> None:
        self.rows += rows
        self.before = min(self.most, self.rows)


def streamed(df: DataFrame, key: str, order: str, columns: Sequence[str], keep: Sequence[str], schema: str, most: int, make: Callable[[History, Mapping[str, np.ndarray]], Mapping[str, np.ndarray]]) -> DataFrame:
    """``keep`` and the columns of ``schema`` (doubles), which ``make`` works out from ``columns`` for each key's rows in order.

    One exchange by key, one sort, one pass; rows of one key stream, so a history of any length is held one batch at a time.
    """
    names = [f.name for f in StructType.fromDDL(schema).fields]
    rows = df.select(*dict.fromkeys([key, order, *keep, *columns])).repartition(key).sortWithinPartitions(key, order)
    kinds = dict(rows.dtypes)
    types = [to_arrow_type(rows.schema[c].dataType) for c in keep]

    def run(batches: Iterator) -> Iterator:
        now, history = None, None
        for b in batches:
            keys = b.column(key).to_numpy(zero_copy_only=False)
            series = {c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            parts: list[Mapping[str, np.ndarray]] = []
            for lo, hi in zip([0, *cut], [*cut, len(keys)], strict=True):
                if lo == hi:
                    continue
                if history is None or keys[lo] != now:
                    now, history = keys[lo], History(most)
                parts.append(make(history, {c: v[lo:hi] for c, v in series.items()}))
                history.ended(hi - lo)
            made = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0), pa.float64(), from_pandas=True) for c in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(t) for c, t in zip(keep, types, strict=True)), *made], [*keep, *names])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema]))
