"""Connected components of an edge table, with nothing gathered on the driver.

Each round joins every node to the smallest node next to it, first through larger
neighbours, then through smaller ones (the large-star and small-star steps of Kiveris et
al., "Connected Components in MapReduce and Beyond", 2014).  Before the first round each
task replaces its edges by a spanning forest, so that what a dense group costs follows
its nodes, not its links.  Rounds end when the edge set no longer changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import releasing, written

FLUSH = 1 << 20


class Forest:
    """Union-find over integers; roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (n := up.get(top, top)) != top:
            top = n
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) for all that are not roots."""
        got = [(x, self.root(x)) for x in list(self.up)]
        got = [(x, r) for x, r in got if x != r]
        return np.array([x for x, _ in got], np.int64), np.array([r for _, r in got], np.int64)


def _forest(batches):
    """Edges of a partition as stars; after every FLUSH nodes the forest starts anew, so memory is bounded."""
    f = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f.join(u, v)
        if len(f.up) > FLUSH:
            u, v = f.edges()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            f = Forest()
    u, v = f.edges()
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another one; a component is named by its smallest node.

    Edges with a null end, loops and repeated edges count for nothing.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = e.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = e.where(F.col("u") != F.col("v"))
    e = written(e.mapInArrow(releasing(_forest), "u long, v long").distinct(), "edges")
    was = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = written(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
