"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Centroids are fitted on the ``SAMPLE`` vectors with the smallest hashes (a bounded sample,
the fit alone; every vector is assigned and compared).  A vector is at home in the cell
of its nearest centroid and visits each further cell whose border lies within ``margin``:
two unit vectors of cosine >= t are at most s = sqrt(2 - 2t) apart, so with margin = s
no link can be missed (``exact=True``).  In d dimensions the part of such a difference
along one border's normal is about s / sqrt(d); by default the margin is 4.5 times that
(s itself up to 20 dimensions).  Norms are taken after division by the largest component,
so neither tiny nor huge vectors lose their direction.

Equal vectors are one vector with a weight from here on, so copies, however many, are
compared once.  The rows of a cell are split into blocks of about ``BLOCK`` numbers of home
vectors.  A task holds one block and streams the cell's other rows past it in batches, so a
group of near copies that a third of all vectors belong to is many tasks of bounded memory.  Each block's rows
see every row that may link to them, so their link counts are complete there, and the
task passes on a spanning forest of its links, not the links.

Cosines are those of double precision: products in single precision decide only pairs
farther than ``BAND`` from the threshold, the rest is worked out in double.

Vectors that are null, zero, or hold null or non-finite components, and rows without an
id link with nothing and are kept.  Vectors of different length do not link.  Every row
counts as a vector of its own in other rows' link counts; rows that repeat an id do not
link with each other.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.components import Forest, components
from panelspark.llm.shared import releasing, table, written

SAMPLE = 20_000
BLOCK = 1 << 18  # numbers
CELL = 2000
MOST_CELLS = 16_384
BAND = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, a bounded number of products at a time."""
    step = max(1, (1 << 23) // len(c))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors, by Lloyd's steps from the first k vectors."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        total = np.add.reduceat(x[order], at, axis=0)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c[near[order][at]] = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c[near[order][at]])
    if not np.isfinite(c).all():
        raise ValueError("a centroid is not finite")
    return c


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, e, n): usable vectors as arrays of double with their length."""
    e = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), e.alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull())
    fine = F.forall("e", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return rows.where(fine & F.exists("e", lambda v: v != 0)).withColumn("n", F.size("e"))


def fit_cells(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from the SAMPLE rows of the smallest hashes."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("e", "n").toPandas()
    out = {}
    for n, part in got.groupby("n"):
        x = unit(np.stack(part["e"].map(np.asarray).to_list()).astype(np.float64))
        k = max(1, min(MOST_CELLS, round(count * len(x) / len(got) / CELL), len(x)))
        out[int(n)] = spherical_kmeans(x, k)
    return out


def _visits(sent, margins: dict[int, float]):
    """Rows (id, e, n, weight) to a row for each cell met: dim, cell, home."""

    def run(batches):
        cells = sent.value
        for pdf in batches:
            for n, part in pdf.groupby("n"):
                c = cells.get(int(n))
                if c is None or len(c) == 1:
                    yield pd.DataFrame({"id": part["id"], "e": part["e"], "weight": part["weight"], "dim": n, "cell": 0, "home": True})
                    continue
                step = max(1, (1 << 22) // len(c))
                for lo in range(0, len(part), step):
                    some = part.iloc[lo : lo + step]
                    dot = unit(np.stack(some["e"].map(np.asarray).to_list())) @ c.T
                    home = dot.argmax(axis=1)
                    gap = dot.max(axis=1, keepdims=True) - dot
                    # centroids are at most 2 apart; how far is worked out for the cells that this leaves
                    r, cell = np.nonzero(gap <= margins[int(n)] * 2 + 1e-9)
                    apart = np.linalg.norm(c[cell] - c[home[r]], axis=1)
                    ok = gap[r, cell] <= margins[int(n)] * apart + 1e-9
                    r, cell = r[ok], cell[ok]
                    yield pd.DataFrame({"id": some["id"].to_numpy()[r], "e": some["e"].to_numpy()[r], "weight": some["weight"].to_numpy()[r], "dim": n, "cell": cell, "home": cell == home[r]})

    return run


def _compare(threshold: float):
    """Units (dim, cell, block), block rows first, to rows (id, links, other): link counts and a forest of links."""

    def run(batches):
        key, ids, base, n_links, forest, wait = None, None, None, None, None, []

        def out():
            a = [(i, r) for i in list(forest.up) if (r := forest.root(i)) != i]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, np.array([i for i, _ in a], np.int64)])), pa.array(list(n_links) + [None] * len(a), pa.int64()), pa.array([None] * n + [r for _, r in a], pa.int64())],
                ["id", "links", "other"])

        def against(oid: np.ndarray, weight: np.ndarray, x: np.ndarray) -> None:
            low = base.astype(np.float32) @ x.T.astype(np.float32)
            r, c = np.nonzero(low >= threshold - BAND)
            close = np.abs(low[r, c] - threshold) <= BAND
            if close.any():
                cr, cc = r[close], c[close]
                ok = np.ones(len(r), bool)
                ok[close] = np.einsum("ij,ij->i", base[cr], x[cc]) >= threshold
                r, c = r[ok], c[ok]
            other = ids[r] != oid[c]
            r, c = r[other], c[other]
            if not len(r):
                return
            np.add.at(n_links, r, weight[c])
            # labels of block rows and batch rows settle to the smallest row reached; one union each follows
            rows, cols = np.arange(len(ids)), np.full(len(oid), len(ids))
            while True:
                np.minimum.at(cols, c, rows[r])
                new = rows.copy()
                np.minimum.at(new, r, cols[c])
                new = new[new]
                if (new == rows).all():
                    break
                rows = new
            for i in np.unique(r):
                forest.join(int(ids[i]), int(ids[rows[i]]))
            for j in np.unique(c):
                forest.join(int(oid[j]), int(ids[cols[j]]))

        def start():
            nonlocal ids, base, n_links, forest, wait
            ids = np.concatenate([w[0] for w in wait])
            base = np.concatenate([w[1] for w in wait])
            weights = np.concatenate([w[2] for w in wait])
            wait, n_links, forest = [], np.zeros(len(ids), np.int64), Forest()
            for lo in range(0, len(ids), 1024):
                against(ids[lo : lo + 1024], weights[lo : lo + 1024], base[lo : lo + 1024])

        for b in batches:
            dims, cells, blocks, own = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vid = b.column(4).to_numpy()
            weight = b.column(5).to_numpy()
            flat = b.column(6)
            cut = np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0) | (np.diff(blocks) != 0) | (np.diff(own.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(vid)], strict=True):
                if lo == hi:
                    continue
                k = (dims[lo], cells[lo], blocks[lo])
                if k != key:
                    if wait:
                        start()
                    if ids is not None:
                        yield from out()
                    key, ids, wait = k, None, []
                part = flat.slice(lo, hi - lo)
                x = unit(part.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1))
                if own[lo]:
                    wait.append((vid[lo:hi], x, weight[lo:hi]))
                else:
                    if wait:
                        start()
                    for at in range(0, hi - lo, 1024):
                        to = min(hi, lo + at + 1024)
                        against(vid[lo + at : to], weight[lo + at : to], x[at : at + 1024])
        if wait:
            start()
        if ids is not None:
            yield from out()

    return run


def links(rows: DataFrame, threshold: float = 0.95, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, links), (a, b)) of distinct usable vectors (id, e, n, weight): summed weights of those linked with each, and a forest of the links."""
    spark = rows.sparkSession
    cells = fit_cells(rows, rows.count())
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    margins = {n: far if exact else min(far, 4.5 * far / np.sqrt(n)) for n in cells}
    sent = spark.sparkContext.broadcast(cells)  # MOST_CELLS centroids a vector length at most
    met = written(rows.mapInPandas(releasing(_visits(sent, margins)), "id long, e array<double>, weight long, dim int, cell int, home boolean"), "cells")
    # a row a cell: at most MOST_CELLS for each vector length
    size = F.greatest(F.lit(256), F.floor(BLOCK / F.greatest("dim", F.lit(1))))
    blocks = met.where("home").groupBy("dim", "cell").agg(F.count("*").alias("c")).select("dim", "cell", F.ceil(F.col("c") / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    units = met.join(blocks, ["dim", "cell"]).withColumn("own", F.when(F.col("home"), own))
    units = units.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "own", "id", "weight", "e")
    units = units.withColumn("other", ~(F.coalesce(F.col("own"), F.lit(-1)) == F.col("block")))
    units = units.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "other")
    got = units.select("dim", "cell", "block", (~F.col("other")).alias("own"), "id", "weight", "e").mapInArrow(releasing(_compare(threshold)), "id long, links long, other long")
    got = written(got, "links")
    return got.where(F.col("links").isNotNull()).select("id", "links"), got.where(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """One row a vector: key, n_links, component_id, kept; the vector with the component's smallest id is kept."""
    usable = valid(vectors, key, vector)
    distinct = written(usable.groupBy("e", "n").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vectors")
    counts, found = links(distinct, threshold, exact)
    copies = distinct.where("weight > 1").select("e", F.col("id").alias("rep"), "weight")
    mine = usable.join(copies, "e", "left").groupBy("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight")).agg(F.count("*").alias("own"))
    mine = written(mine, "copies")
    groups = components(found.union(mine.where("id <> rep").select("id", "rep")), "a", "b")
    # an id under several vectors has a row in ``mine`` for each; the largest count stands
    counts = counts.groupBy("id").agg(F.max("links").alias("links")).withColumnRenamed("id", "rep")
    per_id = mine.join(counts, "rep", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0).cast("long")) + F.greatest(F.col("weight") - F.col("own"), F.lit(0))).alias("n_links"))
    ids = vectors.select(F.col(key).cast("long").alias("_id"), F.col(key))
    out = ids.join(per_id, F.col("_id") == F.col("id"), "left").join(groups, F.col("_id") == F.col("node"), "left")
    component = F.coalesce("component", "_id")
    return out.select(key, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.coalesce(component == F.col("_id"), F.lit(True))).alias("kept"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

QUERIES = {"op3_neardup": op3_neardup}
SQL = {"op3_neardup": OP3_SQL}
