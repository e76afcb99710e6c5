"""Exact deduplication against a history, through minimal perfect hashes of its digests.

Texts are equal when they are identical after lower-casing A-Z; the SHA-256 of the
lower-cased UTF-8 stands for them.  Of equal texts the row with the largest id stays.

The history is an index table: its distinct digests are dealt into buckets of about
``SLOTS``, and a bucket is one row that holds a minimal perfect hash of its n digests onto
the slots 0..n-1 (levels of bits; a digest that falls alone on a bit of a level ends there,
the others try the next one; the slot is the rank of the bit, after Limasset et al., "Fast
and scalable minimal perfect hashing for massive key sets", 2017).  Slots hold the full
digest, the locator of the winning row and the number of rows.

A delivery is looked up bucket by bucket: a hash tells one slot at most, and all 32 bytes of
the digest there are compared.  Members are repeats: they raise the count of their slot and
may supersede its winner.  Nonmembers are grouped by themselves and become entries too, of
which the next index is built.

Rows are summed up by digest in every task before anything is shuffled, so a group of copies
is one row a task, whatever its size.  The few digests that hold over 1/``HEAVY`` of all rows
(fewer than ``HEAVY`` by that) are broadcast when rows meet their entries.

Null text is the empty text.  Texts are read whole.  A row without an id comes after every
row with one; of rows that repeat an id and a text one stays.  An empty table gives an empty
result and an empty index.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import text as X
from panelspark.llm.shared import joined_by_heavy_key, releasing, table, written

SLOTS = 1 << 15
GAMMA = 2  # bits a digest on each level
FLUSH = 1 << 17  # digests that a task sums up before it passes them on
_ENTRY = "digest binary, doc long, at long, n long"


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, at, digest) of every row; ``at`` numbers the rows, so that rows alike in all columns can be told apart."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for lo, hi, data, offs in X.slices(b.column(2)):
                low = memoryview(X.LOWER[data])
                sums = [hashlib.sha256(low[s:e]).digest() for s, e in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sums, pa.binary())], ["doc", "at", "digest"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.monotonically_increasing_id().alias("at"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(run), "doc long, at long, digest binary")


def _words(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of bytes as (n, 4) numbers."""
    return np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (X.mix(words[:, level % 4] ^ salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests: bits of all levels end to end, and the size of each level."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def of(cls, digest: np.ndarray) -> PerfectHash:
        left, sizes, levels = _words(digest), [], []
        while len(left):
            size = GAMMA * len(left)
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            sizes.append(size)
            if len(sizes) > 200:
                raise ValueError("digests are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, bool))

    def slots(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each digest; of a digest that is no key, -1 or any slot."""
        words, base = _words(digest), 0
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = base + _place(words[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += size
        return out


def _flat(col: pa.Array) -> np.ndarray:
    """A column of 32-byte digests as (n, 32) bytes."""
    col = col.cast(pa.binary(32))
    return np.frombuffer(col.buffers()[1], np.uint8)[32 * col.offset : 32 * (col.offset + len(col))].reshape(-1, 32)


def _longs(col: pa.Array, null: int = -(1 << 63)) -> np.ndarray:
    return col.fill_null(null).to_numpy(zero_copy_only=False)


def _batch(digest: np.ndarray, doc: np.ndarray, has: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    whole = pa.Array.from_buffers(pa.binary(32), len(digest), [None, pa.py_buffer(np.ascontiguousarray(digest))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([whole, pa.array(doc, pa.int64(), mask=~has), pa.array(at), pa.array(n)], ["digest", "doc", "at", "n"])


def _summed(batches: Iterator) -> Iterator:
    """Rows (doc, at, digest) to an entry for each digest of a run of about FLUSH rows."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        doc, has, at, digest = (np.concatenate(x) for x in zip(*held, strict=True))
        name = digest.view("V32").ravel()
        _, group = np.unique(name, return_inverse=True)
        order = np.lexsort((at, doc, has, group))
        last = np.flatnonzero(np.diff(group[order], append=-1))
        win = order[last]
        return _batch(digest[win], doc[win], has[win], at[win], np.diff(last, prepend=-1))

    for b in batches:
        if len(b):
            held.append((_longs(b.column(0)), b.column(0).is_valid().to_numpy(zero_copy_only=False), _longs(b.column(1)), _flat(b.column(2))))
            size += len(b)
        if size >= FLUSH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _grouped(entries: DataFrame) -> DataFrame:
    """One entry a digest: its winner (largest id, rows without one last) and its number of rows."""
    won = entries.groupBy("digest").agg(F.max(F.struct("doc", "at")).alias("w"), F.sum("n").alias("n"))
    return won.select("digest", "w.doc", "w.at", "n")


def _bucket(count: int):
    return F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int")


def build_index(entries: DataFrame) -> DataFrame:
    """The index of distinct entries (digest, doc, at, n): a row a bucket with its perfect hash and its slots."""
    buckets = max(1, -(-entries.count() // SLOTS))

    def run(batches: Iterator) -> Iterator:
        key, held = None, []

        def out() -> pa.RecordBatch:
            digest, doc, has, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
            h = PerfectHash.of(digest)
            order = np.argsort(h.slots(digest))  # a permutation: each slot once
            cols = [digest[order], doc[order], has[order].astype(np.uint8), at[order], n[order]]
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int32()), pa.array([h.sizes], pa.list_(pa.int32())), pa.array([np.packbits(h.bits).tobytes()], pa.binary()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)],
                ["bucket", "sizes", "bits", "digests", "docs", "has", "ats", "ns"])

        for b in batches:
            bucket = b.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(bucket)], strict=True):
                if lo == hi:
                    continue
                if bucket[lo] != key:
                    if held:
                        yield out()
                    key, held = int(bucket[lo]), []
                p = b.slice(lo, hi - lo)
                held.append((_flat(p.column(1)), _longs(p.column(2)), p.column(2).is_valid().to_numpy(zero_copy_only=False), _longs(p.column(3)), _longs(p.column(4))))
        if held:
            yield out()

    rows = entries.select(_bucket(buckets).alias("bucket"), "digest", "doc", "at", "n").repartition("bucket").sortWithinPartitions("bucket")
    made = rows.mapInArrow(releasing(run), "bucket int, sizes array<int>, bits binary, digests binary, docs binary, has binary, ats binary, ns binary")
    return written(made.withColumn("buckets", F.lit(buckets)), "index")


class _Slots:
    """An opened bucket: its hash and its slots, whose winners and counts follow the delivery."""

    def __init__(self, row: dict):
        n = len(row["has"])
        sizes = row["sizes"]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        self.hash = PerfectHash(sizes, bits)
        self.digest = np.frombuffer(row["digests"], np.uint8).reshape(n, 32)
        self.doc, self.at, self.n = (np.frombuffer(row[c], np.int64).copy() for c in ("docs", "ats", "ns"))
        self.has = np.frombuffer(row["has"], np.uint8).astype(bool)

    def absorb(self, digest: np.ndarray, doc: np.ndarray, has: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds the members among the entries to their slots; which entries are members."""
        slot = self.hash.slots(digest)
        member = slot >= 0
        member[member] = (self.digest[slot[member]] == digest[member]).all(axis=1)
        s, doc, has, at, n = slot[member], doc[member], has[member], at[member], n[member]
        np.add.at(self.n, s, n)
        order = np.lexsort((at, doc, has, s))
        s = s[order]
        win = order[np.flatnonzero(np.diff(s, append=-1))]
        s = slot[member][win]
        new = np.stack([has[win], doc[win], at[win]])
        old = np.stack([self.has[s], self.doc[s], self.at[s]])
        later = (new[0] > old[0]) | (new[0] == old[0]) & ((new[1] > old[1]) | (new[1] == old[1]) & (new[2] > old[2]))
        s, win = s[later], win[later]
        self.has[s], self.doc[s], self.at[s] = has[win], doc[win], at[win]
        return member


def absorb(index: DataFrame | None, delivery: DataFrame) -> DataFrame:
    """Entries (digest, doc, at, n, repeats) after a delivery of rows (doc, at, digest).

    ``repeats`` counts the rows of the delivery that were found in the index.  Without an
    index every row is new.
    """
    summed = delivery.mapInArrow(releasing(_summed), _ENTRY)
    if index is None:
        return written(_grouped(summed).withColumn("repeats", F.lit(0).cast("long")), "entries")
    first = index.select("buckets").first()
    if first is None:
        return absorb(None, delivery)

    def run(batches: Iterator) -> Iterator:
        names = ["digest", "doc", "at", "n", "repeats", "known"]
        key, slots, before = None, None, None

        def out() -> pa.RecordBatch:
            b = _batch(slots.digest, slots.doc, slots.has, slots.at, slots.n)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(slots.n - before), pa.array(np.ones(len(slots.n), bool))], names)

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            kind = b.column("kind").to_numpy()
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(bucket)], strict=True):
                if lo == hi:
                    continue
                if bucket[lo] != key:
                    if slots is not None:
                        yield out()
                    key, slots = bucket[lo], None
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    slots = _Slots(part.to_pylist()[0])
                    before = slots.n.copy()
                    continue
                e = (_flat(part.column("digest")), _longs(part.column("doc")), part.column("doc").is_valid().to_numpy(zero_copy_only=False), _longs(part.column("at")), _longs(part.column("n")))
                new = np.ones(hi - lo, bool) if slots is None else ~slots.absorb(*e)
                if new.any():
                    b2 = _batch(*(x[new] for x in e))
                    yield pa.RecordBatch.from_arrays([*b2.columns, pa.array(np.zeros(len(b2), np.int64)), pa.array(np.zeros(len(b2), bool))], names)
        if slots is not None:
            yield out()

    held = index.drop("buckets").withColumn("kind", F.lit(0).cast("byte"))
    asked = summed.withColumns({"bucket": _bucket(first["buckets"]), "kind": F.lit(1).cast("byte")})
    both = held.unionByName(asked, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "kind")
    met = written(both.mapInArrow(releasing(run), f"{_ENTRY}, repeats long, known boolean"), "met")
    fresh = _grouped(met.where("NOT known").drop("known")).withColumn("repeats", F.lit(0).cast("long"))
    return written(met.where("known").drop("known").unionByName(fresh), "entries")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, repeat) for each row.

    The rows come as two deliveries in the order of their ids: up to the middle of the ids'
    range (rows without an id too), and beyond.  The first makes the history, the second is
    looked up in it; ``repeat`` tells whether the row's text was there already when its
    delivery came.
    """
    rows = written(digests(docs, key, text), "digests")
    ends = rows.agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).first()
    middle = ((ends["lo"] or 0) + (ends["hi"] or 0)) // 2
    late = F.coalesce(F.col("doc") > middle, F.lit(False))
    index = build_index(absorb(None, rows.where(~late)))
    entries = absorb(index, rows.where(late))
    won = entries.select("digest", F.col("doc").alias("keep_id"), F.col("at").alias("keep_at"), F.col("n").alias("group_size"), "repeats")
    out = joined_by_heavy_key(rows, won, "digest", "group_size", ends["n"])
    return out.select(
        F.col("doc").alias(key), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), (late & (F.col("repeats") > 0)).alias("repeat"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents, and which row of each stays."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("repeat")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

QUERIES = {"op11_exact": op11_exact}
SQL = {"op11_exact": OP11_SQL}
