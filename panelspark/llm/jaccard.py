"""N-gram Jaccard join with a token-group matrix (after Li et al., "LES3", VLDB 2021).

A document is the set of its distinct k-word shingles.  Two documents link if the
intersection of their sets is at least ``num``/``den`` of the union.  The join is exact:

1. Equal sets are one set from here on (``copies``).
2. Sets are partitioned into groups of similar ones: sets that share a min-hash are held
   against the one with the smallest id, and verified links are closed to groups.
3. The token-group matrix holds, for each block of at most about ``BLOCK`` sets and
   ``BLOCK_TOKENS`` tokens of a group, the union of its members' tokens.  It is used in two
   steps.  Shuffled first are only its columns that the prefix filter needs: by one order of
   tokens for all sets, rare ones first, two sets can only reach the threshold if the first
   n - ceil(t*n) + 1 tokens of the larger meet the first n - ceil(2t/(1+t)*n) + 1 of the
   smaller.  With prefixes this short one match within the position bounds is all that can
   be asked for.  Groups of a query's own group number are connected already and skipped.
4. For the groups that are left the members' sets are fetched and the whole token union is
   built; the query's overlap with it is counted and bounds that with every member.  Only a
   group that still qualifies is opened: members are compared until one links, which joins
   the two groups.

The order of tokens comes from a sketch of document frequencies with ``COUNTERS``
counters, summed over all documents and kept as a byte each: its size is fixed, and any order gives the same
links, only not as fast.  Tokens are 64-bit hashes of shingles.

Null or empty texts, and texts without words, have empty sets and link with nothing.
Texts with fewer than k words are one shingle.  Texts are used whole.  Rows without an id
keep a null component.  Rows that repeat an id count as one document for linking and are
all returned.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import text as X
from panelspark.llm.components import components
from panelspark.llm.shared import empty_texts, releasing, table, written

COUNTERS = 1 << 24
CHUNK = 1 << 18
KEYS = 3
BLOCK = 256
BLOCK_TOKENS = 1 << 18
FILTER_BITS = 1 << 26
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def _summed(parts: DataFrame, kind: str, wide: str, join) -> list[tuple[int, bytes]]:
    """Arrays that tasks made, joined in type ``wide`` by chunks of CHUNK elements; the chunks are compressed, and those of zeros alone left out."""

    def run(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.frombuffer(zlib.decompress(data), kind).astype(wide)
                got[c] = join(got[c], a) if c in got else a
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([zlib.compress(a.tobytes(), 1) for a in got.values()], pa.binary())], ["chunk", "data"])

    rows = parts.repartition("chunk").mapInArrow(releasing(run), "chunk int, data binary")
    return [(r["chunk"], bytes(r["data"])) for r in rows.toLocalIterator()]  # fixed size


def _opened_chunks(chunks: list[tuple[int, bytes]], wide: str):
    """(place of its first element, elements) of each chunk, one at a time."""
    for i, data in chunks:
        yield i * CHUNK, np.frombuffer(zlib.decompress(data), wide)


def _chunks(a: np.ndarray) -> pa.RecordBatch:
    parts = [(i, zlib.compress(a[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1)) for i in range(-(-len(a) // CHUNK)) if a[i * CHUNK : (i + 1) * CHUNK].any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], ["chunk", "data"])


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """A byte for each counter: how far the number of documents that hold a shingle of its hash is over what chance puts there.

    Steps are half a standard deviation of the counters' usual load, so that frequent
    shingles stand out at every size of the corpus.
    """

    def run(batches):
        n = np.zeros(COUNTERS, np.uint16)
        for b in batches:
            for _, _, data, offs in X.slices(b.column(0)):
                at = [(s & np.uint64(COUNTERS - 1)).astype(np.int64) for s in X.shingle_sets(data, offs, k)]
                at, more = np.unique(np.concatenate(at), return_counts=True)
                n[at] = np.minimum(n[at] + more, 65535)
        yield _chunks(n)

    parts = docs.select("text").mapInArrow(releasing(run), "chunk int, data binary")
    # the driver opens one chunk at a time and keeps a byte a counter
    total = _summed(parts, "uint16", "int64", np.add)
    step = max(1, COUNTERS >> 16)
    some = np.zeros(COUNTERS // step, np.int64)
    for at, a in _opened_chunks(total, "int64"):
        some[at // step : at // step + len(a) // step] = a[::step]
    usual = float(np.median(some))

    def shown(a: np.ndarray | float) -> np.ndarray:
        return np.clip((a - usual) / np.sqrt(usual + 1) * 2 + 16, 0, 255).astype(np.uint8)

    out = np.full(COUNTERS, shown(np.zeros(1))[0], np.uint8)
    for at, a in _opened_chunks(total, "int64"):
        out[at : at + len(a)] = shown(a)
    return out


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash) of ids in a bitmap of fixed size."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[(X.mix(b.column(0).to_numpy().astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        yield _chunks(np.packbits(bits))

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for at, a in _opened_chunks(_summed(ids.mapInArrow(releasing(run), "chunk int, data binary"), "uint8", "uint8", np.bitwise_or), "uint8"):
        out[at : at + len(a)] = a
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))


def records(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, fp, mins, prefix): size, digest and min-hashes of each set, and its first tokens in the common order."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))  # COUNTERS bytes

    def run(batches):
        counts = order.value
        for b in batches:
            for lo, hi, data, offs in X.slices(b.column(1)):
                n, fp, mins, prefix = [], [], [], []
                for s in X.shingle_sets(data, offs, k):
                    n.append(len(s))
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    mins.append(np.array([X.mix(s ^ seed).min() for seed in _SEEDS[:KEYS]], np.uint64) if len(s) else s)
                    keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    often = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    if keep < len(s):
                        # the keep smallest by (frequency, token)
                        edge = np.partition(often, keep - 1)[keep - 1]
                        at = np.flatnonzero(often <= edge)
                        at = at[np.argsort(often[at], kind="stable")][:keep]  # tokens are sorted already
                    else:
                        at = np.argsort(often, kind="stable")
                    prefix.append(s[at])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), _lists(mins), _lists(prefix)], ["id", "n", "fp", "mins", "prefix"])

    return docs.select("id", "text").mapInArrow(releasing(run), "id long, n int, fp binary, mins array<long>, prefix array<long>")


def with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id and other columns) with the text of its ids."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("id")))  # FILTER_BITS bits

    def near(batches):
        m = bits.value
        for b in batches:
            at = X.mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(FILTER_BITS - 1)
            yield b.filter(pa.array((m[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)))

    # what the filter lets through goes to the join; the filter only saves shuffling the rest
    some = docs.select("id", "text").where(F.col("id").isNotNull()).mapInArrow(releasing(near), "id long, text string")
    return some.join(wanted, "id")


def _with_sets(batch: pa.RecordBatch, k: int):
    """The batch's rows with the set of the last column, a text, in its place."""
    sets = [s for _, _, data, offs in X.slices(batch.column(batch.num_columns - 1)) for s in X.shingle_sets(data, offs, k)]
    return zip(*(c.to_pylist() for c in batch.columns[:-1]), sets, strict=True)


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _leaders(k: int, num: int, den: int):
    """Rows (k, key, salt, id, text), smallest id first in each run, to links (a, b) with the first of the run."""

    def run(batches):
        at, lead, first = None, None, None
        for b in batches:
            out = []
            for key_k, key, salt, i, s in _with_sets(b, k):
                if (key_k, key, salt) != at:
                    at, lead, first = (key_k, key, salt), s, i
                elif i != first and _linked(lead, s, num, den):
                    out.append((i, first))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def _min_hash(s: np.ndarray, i: int) -> int:
    return int(X.mix(s ^ _SEEDS[i]).min())


def _key_bits(keys: np.ndarray) -> np.ndarray:
    return X.mix(keys.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)


def similar_groups(sets: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) of each set to the smallest id of its run; a run is the sets of one min-hash.

    Which min-hashes are shared goes to the tasks as a bitmap of fixed size, so texts are
    shuffled once, straight to their runs.  Runs of frequent min-hashes (a second bitmap)
    are dealt out by a hash of the id that differs from key to key, so that a large group
    is split for one key and joined again by the others.
    """
    keyed = sets.select("id", F.posexplode("mins").alias("k", "key"))
    often = written(keyed.groupBy("k", "key").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    salts = np.uint64(max(2, (often.agg(F.max("c")).first()[0] or 0) // (4 * BLOCK)))  # so that a share of the largest run is of bounded size
    sent = docs.sparkSession.sparkContext.broadcast((id_filter(often.select("key")), id_filter(often.where(F.col("c") > 16 * BLOCK).select("key"))))  # twice FILTER_BITS bits

    def has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
        at = _key_bits(key)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    def run(batches):
        shared, hot = sent.value
        sent_ids: dict[int, int] = {}  # of each set, so that a task passes on the smallest id of its copies
        for b in batches:
            met = [s for _, _, data, offs in X.slices(b.column(1)) for s in X.shingle_sets(data, offs, k)]
            ids = b.column(0).to_numpy()
            rows = []
            for r in np.argsort(ids, kind="stable").tolist():
                if len(met[r]) and sent_ids.get(copy := hash(met[r].tobytes()), ids[r] + 1) > ids[r]:
                    sent_ids[copy] = ids[r]
                    rows.append(r)
            rows, ids = np.array(rows, np.int64), ids.astype(np.uint64)
            for i in range(KEYS):
                key = np.array([_min_hash(met[r], i) for r in rows], np.uint64)
                ok = has(shared, key)
                at, key = rows[ok], key[ok]
                salt = np.where(has(hot, key), X.mix(ids[at] + np.uint64(i)) % salts, np.uint64(0)).astype(np.int64)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(key.view(np.int64)), pa.array(salt), *part.columns], ["k", "key", "salt", "id", "text"])

    rows = docs.select("id", "text").where(F.col("id").isNotNull()).mapInArrow(releasing(run), "k int, key long, salt long, id long, text string")
    rows = rows.repartition("k", "key", "salt").sortWithinPartitions("k", "key", "salt", "id")
    return rows.mapInArrow(releasing(_leaders(k, num, den)), "a long, b long")


def _opened(k: int, num: int, den: int):
    """Rows (grp, block, query, id, text), members first in each run, to links (a, b) of queries with a member."""

    def run(batches):
        key, members, union = None, [], None
        for b in batches:
            out = []
            for grp, block, query, i, s in _with_sets(b, k):
                if (grp, block) != key:
                    key, members, union = (grp, block), [], None
                if not query:
                    members.append((i, s))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m for _, m in members])) if members else s[:0]
                at = np.searchsorted(union, s)
                at[at == len(union)] = 0
                if not len(union) or den * int((union[at] == s).sum()) < num * len(s):
                    continue  # not even all the group's tokens together reach the threshold
                for j, m in members:
                    if _linked(s, m, num, den):
                        out.append((i, j))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def group_links(sets: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of different groups, one at least where two groups are linked; ``sets`` has grp and block."""
    rows = sets.select("id", "grp", "block", "n", F.posexplode("prefix").alias("p", "token"))
    rows = rows.withColumn("rest", F.col("n") - F.col("p") - 1)  # tokens after this one
    # the smaller set of a pair is met through the shorter prefix: n - ceil(2*num*n / (num + den)) + 1 tokens
    held = F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(num + den)) + 1
    # dealt by token alone, as the join needs it
    matrix = rows.where(F.col("p") < held).repartition("token").groupBy("token", "grp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("most"))
    m = matrix.select("token", F.col("grp").alias("g"), F.col("block").alias("gb"), "lo", "hi", "most")
    # at the first token that two sets share, the overlap is one and what is left of either at most
    reach = (F.least("rest", "most") + 1) * (num + den) >= (F.col("n") + F.col("lo")) * num
    fits = reach & (F.col("g") != F.col("grp")) & (F.col("lo") <= F.col("n")) & (F.col("hi") * den >= F.col("n") * num)
    met = rows.join(m, (rows["token"] == m["token"]) & fits).select("id", "g", "gb").distinct()
    met = written(met, "candidates")
    opened = met.select("g", "gb").distinct()
    members = sets.select("id", F.col("grp").alias("g"), F.col("block").alias("gb")).join(opened, ["g", "gb"], "left_semi")
    each = met.select("g", "gb", F.lit(True).alias("query"), "id").union(members.select("g", "gb", F.lit(False).alias("query"), "id"))
    # a set is a row for each group it may open, and one as a member of its block
    rows = with_text(docs, written(each, "runs"))
    rows = rows.repartition("g", "gb").sortWithinPartitions("g", "gb", "query")
    return rows.select("g", "gb", "query", "id", "text").mapInArrow(releasing(_opened(k, num, den)), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row; thresholds over one half."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must be over 1/2 and at most 1")
    docs = empty_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    all_sets = written(records(docs, k, num, den), "records")
    copies = all_sets.where("n > 0 AND id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    copies = written(copies, "copies")
    # one row a set; rows that repeat id and set are alike in all columns
    some = all_sets.select("id", "n", "fp", "mins").join(copies.select("fp", F.col("rep").alias("id")), ["fp", "id"], "left_semi").dropDuplicates(["fp", "id"])
    near = written(similar_groups(some, docs, k, num, den), "near")
    groups = components(near)
    named = written(copies.select(F.col("rep").alias("id"), "fp").join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", "fp", F.coalesce("component", "id").alias("grp")), "groups")
    sized = named.join(all_sets.select("id", "fp", "n"), ["id", "fp"]).groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    sizes = sized.select("grp", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("t") / BLOCK_TOKENS)).cast("int").alias("blocks")).where("blocks > 1")
    named = named.join(sizes, "grp", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")
    sets = all_sets.select("id", "fp", "n", "prefix").join(named, ["id", "fp"])
    across = written(group_links(sets, docs, k, num, den), "across")
    same = all_sets.where("n > 0").select("id", "fp").join(copies, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = components(near.union(across).union(same))
    out = all_sets.select("id", "n").join(whole, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by Jaccard >= 0.85 on 4-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n FROM s),
t AS (SELECT doc_id, hash(unnest(s)) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM n LEFT JOIN m ON a = doc_id
"""

QUERIES = {"op1_jaccard": op1_jaccard}
SQL = {"op1_jaccard": OP1_SQL}
