"""Vector code compression: product codes in integer arithmetic, with norm-of-sum bounds.

A component x becomes floor(4096 * x).  A vector is cut into ``PARTS`` equal consecutive
parts; the codebook of each part position starts as that part of the ``ENTRIES`` vectors
with the smallest ids.  A round assigns every part to the nearest entry of its codebook
(squared distance, ties to the lower index) and then replaces each entry by the floor of
its parts' mean; an entry without parts stays.  After ``ROUNDS`` rounds parts are assigned
once more.  All distances and sums are exact.

Between rounds each part keeps, besides its entry, a lower bound of its distance to all
other entries and the round in which that bound was measured.  The codebooks of all rounds
are kept.  A bound of round s holds in round t after the largest distance between an
entry's places in s and in t is taken off: the norm of the sum of its moves, never more
than the sum of their norms, which is what bounds corrected round by round lose (Newling
and Fleuret, "Fast k-means with accurate bounds", 2016).  A part whose own entry is nearer
than that is left as it is; the others are measured against all entries again.  Bounds are
rounded to the safe side, so they save work and change nothing.

The vectors with their state (10 bytes a part) are written once a round, the round before
is removed.  What meets on the driver has the size of the codebooks.

Vectors that are null or hold null or non-finite components are dropped.  Vectors of
another length have codebooks of their own; a length that ``PARTS`` does not divide is
filled up with zeros.  With fewer than ``ENTRIES`` vectors there are as many entries as
vectors.  Rows that repeat an id count each; among equal ids the order of their bytes
decides, and rows without an id come last.  Null labels are one label.  An empty table gives
an empty result.  Other columns are ignored.  A component whose error might not fit into a
long (for 64 components, about 2**27 steps) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelspark.llm.shared import discard, joined_by_heavy_key, releasing, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SAFE = 1e-9  # far over the rounding of a square root
ROWS = 4096


def _width(n: int) -> int:
    return -(-n // PARTS)


def quantised(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, n, q): usable vectors as 32-bit integers, filled up to PARTS equal parts; n is their own length."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("e")).where("e IS NOT NULL")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            e = b.column(2)
            flat = e.flatten().to_numpy(zero_copy_only=False)  # null becomes NaN
            offs = np.concatenate([[0], np.cumsum(e.value_lengths().to_numpy())]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = bad[offs[1:]] == bad[offs[:-1]]
            sizes = np.diff(offs)
            for n in np.unique(sizes[fine]).tolist():
                at = np.flatnonzero(fine & (sizes == n))
                w = _width(n)
                x = np.zeros((len(at), PARTS * w))
                x[:, :n] = np.floor(flat[offs[at][:, None] + np.arange(n)] * SCALE)
                if x.size and not float(np.abs(x).max()) < np.sqrt(2.0**61 / (PARTS * w)) < 2.0**31:
                    raise ValueError("a component is too large for exact errors")
                q = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), q], ["id", "label", "n", "q"])

    return rows.mapInArrow(releasing(run), f"id {kinds['id']}, label {kinds['label']}, n int, q binary")


def _of(col: pa.Array, kind: str, m: int) -> np.ndarray:
    """A column of equally long byte strings as m rows."""
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + m + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.view(kind).reshape(m, -1)


def _rows(a: np.ndarray) -> pa.Array:
    """m equal rows as byte strings."""
    m, size = len(a), a.itemsize * a.shape[1]
    offs = pa.py_buffer((np.arange(m + 1, dtype=np.int32) * size).tobytes())
    return pa.Array.from_buffers(pa.binary(), m, [None, offs, pa.py_buffer(np.ascontiguousarray(a))])


class Bounds:
    """The codebooks of all rounds so far (PARTS, entries, width), and how far entries went since each of them."""

    def __init__(self, history: list[np.ndarray], wide: bool):
        # in double precision as long as every product and sum is an integer below 2**53
        self.kind = np.int64 if wide else np.float64
        self.now = history[-1].astype(self.kind)
        self.square = (self.now**2).sum(axis=2)
        self.round = len(history) - 1
        moved = np.array([np.sqrt(((self.now - c) ** 2).sum(axis=2).astype(np.float64)) for c in history])  # by round, part and entry
        # the largest net move of all entries but one
        top = np.sort(moved, axis=2)[:, :, -2:]
        self.others = np.where(moved == top[:, :, -1:], top[:, :, :1] if moved.shape[2] > 1 else 0.0, top[:, :, -1:]) * (1 + SAFE)

    def scan(self, p: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry, squared distance to it, and a lower bound of the distance to all others."""
        d = (x**2).sum(axis=1)[:, None] - 2 * (x @ self.now[p].T) + self.square[p]
        code = d.argmin(axis=1)
        at = np.arange(len(x))
        own = d[at, code]
        if d.shape[1] == 1:
            return code, own, np.full(len(x), np.inf)
        second = np.partition(d, 1, axis=1)[:, 1]
        return code, own, np.sqrt(second.astype(np.float64)) * (1 - SAFE)

    def assign(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Brings code, bound and stamp (rows, PARTS) up to this round; squared distances to the own entries, and rescans by part."""
        own = np.zeros(code.shape, self.kind)
        scans = np.zeros(PARTS, np.int64)
        for p in range(PARTS):
            part = x[:, p]
            if self.round:
                own[:, p] = ((part - self.now[p][code[:, p]]) ** 2).sum(axis=1)
                far = bound[:, p] - self.others[stamp[:, p], p, code[:, p]]
                todo = np.flatnonzero(~(np.sqrt(own[:, p].astype(np.float64)) * (1 + SAFE) < far))
            else:
                todo = np.arange(len(x))
            scans[p] = len(todo)
            if len(todo):
                code[todo, p], own[todo, p], bound[todo, p] = self.scan(p, part[todo])
                stamp[todo, p] = self.round
        return own, scans


def assigned(state: DataFrame, history: dict[int, list[np.ndarray]], last: bool) -> DataFrame:
    """One round: rows with their state (part null), and for each task, part and entry the sum of what was assigned to it."""
    sent = state.sparkSession.sparkContext.broadcast(history)  # the codebooks of all rounds
    kinds = dict(state.dtypes)
    first = "code" not in kinds
    names = ["id", "label", "n", "q", "code", "bound", "stamp", "error", "part", "entry", "members", "scans", "sums"]
    schema = f"id {kinds['id']}, label {kinds['label']}, n int, q binary, code binary, bound binary, stamp binary, error long, part int, entry int, members long, scans long, sums array<long>"
    types = [to_arrow_type(state.schema[c].dataType) for c in ("id", "label")]

    def run(batches: Iterator) -> Iterator:
        totals: dict[int, tuple] = {}
        models: dict[int, Bounds] = {}
        for whole in batches:
            sizes = whole.column(2).to_numpy()
            for n in np.unique(sizes).tolist():
                books = sent.value[n]
                k, w = books[0].shape[1:]
                same = whole.filter(pa.array(sizes == n)) if (sizes != n).any() else whole
                for lo in range(0, len(same), ROWS):
                    b = same.slice(lo, ROWS)
                    m = len(b)
                    q = _of(b.column(3), "<i4", m) if w else np.empty((m, 0), np.int32)
                    if n not in models:
                        models[n] = Bounds(books, wide=True)
                        totals[n] = (np.zeros((PARTS, k), np.int64), np.zeros(PARTS, np.int64), np.zeros((PARTS, k, w), np.int64))
                    top = max(int(np.abs(q).max(initial=0)), int(np.abs(books[-1]).max(initial=0)))
                    wide = 4 * max(w, 1) * top * top >= 1 << 52
                    if wide != (models[n].kind is np.int64):
                        models[n] = Bounds(books, wide)
                    model = models[n]
                    x = q.reshape(m, PARTS, w).astype(model.kind)
                    if first:
                        code, bound, stamp = np.zeros((m, PARTS), np.uint8), np.zeros((m, PARTS)), np.zeros((m, PARTS), np.uint8)
                    else:
                        code, bound, stamp = (_of(b.column(i), kind, m).copy() for i, kind in ((4, "u1"), (5, "<f8"), (6, "u1")))
                    own, scans = model.assign(x, code, bound, stamp)
                    members, rescans, sums = totals[n]
                    rescans += scans
                    for p in range(PARTS):
                        members[p] += np.bincount(code[:, p], minlength=k)
                        one = (code[:, p] == np.arange(k, dtype=np.uint8)[:, None]).astype(model.kind)
                        sums[p] += (one @ x[:, p]).astype(np.int64)
                    none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], _rows(code), _rows(bound), _rows(stamp), pa.array(own.sum(axis=1).astype(np.int64)), *none], names)
        for n, (members, rescans, sums) in totals.items():
            if last:
                break
            k = members.shape[1]
            size = PARTS * k
            part, entry = np.divmod(np.arange(size), k)
            lists = pa.array(list(sums.reshape(size, -1)), pa.list_(pa.int64()))
            none = [pa.nulls(size, t) for t in (*types, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            none[2] = pa.array(np.full(size, n, np.int32))
            cols = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(members.ravel()), pa.array(np.where(entry == 0, rescans[part], 0)), lists]
            yield pa.RecordBatch.from_arrays([*none, *cols], names)

    return state.mapInArrow(releasing(run), schema)


def _replaced(done: DataFrame, books: dict[int, list[np.ndarray]]) -> tuple[dict[int, np.ndarray], int]:
    """The next codebook of each length, from the sums of all tasks, and how many parts were measured against all entries."""
    sums = done.where("part IS NOT NULL")
    each = sums.select("n", "part", "entry", F.posexplode("sums").alias("i", "x")).groupBy("n", "part", "entry", "i").agg(F.sum("x").alias("x"))
    counts = sums.groupBy("n", "part", "entry").agg(F.sum("members").alias("c"), F.sum("scans").alias("s")).collect()  # a row an entry
    new = {n: b[-1].copy() for n, b in books.items()}
    size = {(r["n"], r["part"], r["entry"]): r["c"] for r in counts}
    for r in each.collect():  # a row for each component of a codebook
        if c := size[r["n"], r["part"], r["entry"]]:
            new[r["n"]][r["part"], r["entry"], r["i"]] = r["x"] // c
    return new, sum(r["s"] for r in counts)


def learn(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]], list[int]]:
    """Rows (id, label, n, q) with their final code and error; the codebooks of all rounds by vector length; the parts rescanned in each."""
    state = written(rows, "vectors")
    books: dict[int, list[np.ndarray]] = {}
    for r in state.select("n").distinct().collect():  # lengths of vectors
        n = r["n"]
        start = state.where(F.col("n") == n).select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).collect()
        q = np.array([np.frombuffer(x["q"], "<i4") for x in start], np.int64).reshape(len(start), PARTS, _width(n))
        books[n] = [q.transpose(1, 0, 2).copy()]
    scans = []
    for t in range(rounds + 1):
        done = written(assigned(state, books, last=t == rounds), f"round{t}")
        discard(state)
        state = done.where("part IS NULL").select("id", "label", "n", "q", "code", "bound", "stamp", "error")
        if t < rounds:
            new, scanned = _replaced(done, books)
            scans.append(scanned)
            for n, b in new.items():
                books[n].append(b)
    return state, books, scans


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable vector."""
    state, books, _ = learn(quantised(vectors, key, vector, label), rounds)
    rows = state.select("id", "label", "n", F.lower(F.hex("code")).alias("code"), "error")
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    out = joined_by_heavy_key(rows, written(totals, "labels"), "label", "_n", rows.count())
    sha = F.lit(None).cast("string")
    for n, b in books.items():
        sha = F.when(F.col("n") == n, hashlib.sha256(",".join(map(str, b[-1].ravel().tolist())).encode()).hexdigest()).otherwise(sha)
    return out.select(F.col("id").alias(key), "code", "error", "label_error", sha.alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, with errors by vector and by label."""
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as one chain of common tables; distance and entry are one number, so ties go to the lower entry."""

    def near(t: int) -> str:
        return f"""a{t} AS MATERIALIZED (SELECT vec_id, v.part, min(list_sum(list_transform(range(1, w + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::HUGEINT * {ENTRIES} + entry) AS m
FROM p v JOIN c{t} c ON v.part = c.part GROUP BY vec_id, v.part)"""

    def move(t: int) -> str:
        return f"""s{t} AS (SELECT a.part, (m % {ENTRIES})::INT AS entry, unnest(range(1, w + 1)) AS i, unnest(q) AS x FROM a{t} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part),
g{t} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM s{t} GROUP BY part, entry, i),
l{t} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM g{t} GROUP BY part, entry),
c{t + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(l.q, c.q) AS q FROM c{t} c LEFT JOIN l{t} l ON l.part = c.part AND l.entry = c.entry)"""

    steps = ",\n".join(near(t) + (",\n" + move(t) if t < ROUNDS else "") for t in range(ROUNDS + 1))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, w, part, q[part * w + 1 : part * w + w] AS q FROM v, range({PARTS}) r(part)),
c0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INT AS entry, q FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
{steps},
e AS (SELECT vec_id, string_agg(printf('%02x', (m % {ENTRIES})::INT), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id), b
"""


QUERIES = {"op13_codes": op13_codes}
SQL = {"op13_codes": _sql()}
