"""Suffix-array deduplication: bytes covered by strings of ``length`` bytes that start more than once.

A string is repeated if two suffixes of the corpus share their first ``length`` bytes,
so it is enough to sort suffixes and look at neighbours.  No suffix array of the whole
corpus is built; suffixes meet by content:

1. Every window of ``length`` bytes has an anchor: the smallest hash among its substrings
   of half that length.  Equal windows have equal anchors, and consecutive windows share
   theirs, so about one position in fifty is shuffled, as (anchor, digest of the bytes
   that the anchor's windows span, place).  Equal spans are repeated whole; a task settles
   those it holds itself first and passes on one of each, so copies do not pile up.
2. Spans that share an anchor but differ (the ends of a repeated passage) are fetched.
   Their suffixes are sorted by a mergesort whose comparisons find common extensions by
   binary search over prefix polynomial hashes; neighbours that share ``length`` bytes
   are repeated, which is verified byte by byte.  Only suffixes at the same distance to
   the same anchor can be equal, so each such class is sorted by itself.  A group of more
   than ``GROUP`` spans is sorted in parts, and the windows left over are matched across
   the parts by an aggregation over their hashes.
3. The byte ranges of each distinct text are united and cut out.

Spans are told apart by 64 bits of a cryptographic digest under the 64-bit hash of their
anchor, texts by SHA-256; a text that occurs twice repeats as a whole.
Null text is empty.  Texts shorter than ``length`` keep all their bytes, whatever they
repeat.  Matches lie within one text.  Texts are used whole.  Repeated rows are copies of
each other.  An empty table gives an empty result; extra columns are ignored.  What is
kept is bytes: a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import text as X
from panelspark.llm.jaccard import FILTER_BITS, id_filter
from panelspark.llm.shared import empty_texts, releasing, table, written

GROUP = 4096
LOW = np.uint64(0xFFFFFFFF)
U = np.uint64


def _anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: row, first and last window, anchor's place, anchor hash."""
    half = length // 2
    n = len(data)
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if n < length:
        return none
    sums = X.prefix_hash(data)
    _, inverse = X.powers(n + 1)
    grams = X.mix((sums[half:] - sums[:-half]) * inverse[: n - half + 1])
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    wide, have = length - half + 1, 1
    while have < wide:  # least[i] covers the ``have`` grams from i on
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    if not len(row):
        return none
    before = np.concatenate([[0], np.cumsum(np.maximum(size - length + 1, 0))])
    window = np.arange(len(row)) - before[row] + offs[row]
    place = (least[window] & LOW).astype(np.int64)
    cut = np.flatnonzero((place[1:] != place[:-1]) | (row[1:] != row[:-1])) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
    anchor = grams[place[lo]]
    r = row[lo]
    return r, window[lo] - offs[r], window[hi] - offs[r], place[lo] - offs[r], anchor


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """64 bits of each string's BLAKE2b; two strings are told apart by these and by the hash of their anchor."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=8).digest() for p in parts]), np.uint64)


def _merged(text: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each text united where they meet; any order in, order of text and place out."""
    o = np.lexsort((lo, text))
    text, lo, end = text[o], lo[o], end[o]
    if not len(text):
        return text, lo, end
    base = np.zeros(len(text), np.int64)  # texts one behind the other, so that one running maximum does
    new_text = np.flatnonzero(text[1:] != text[:-1]) + 1
    tops = np.maximum.reduceat(end, np.concatenate([[0], new_text]))
    base[new_text] = tops[:-1] + 1
    base = np.cumsum(base)
    reach = np.maximum.accumulate(end + base)
    first = np.concatenate([[True], (lo + base)[1:] > reach[:-1]])
    first[new_text] = True
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(text)]]) - 1
    return text[at], lo[at], reach[last] - base[last]


def _found(length: int):
    """Rows (tid, text) to rows (key, span, tid, at): anchors with their window runs, and (span null) ranges settled in the task.

    ``at`` packs two places of 31 bits and, lowest, whether the task settled the span.
    """

    def run(batches):
        got: list[list[np.ndarray]] = [[] for _ in range(5)]
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, offs in X.slices(b.column(1)):
                r, first, last, _, anchor = _anchors(data, offs, length)
                raw = data.tobytes()
                span = digests(raw[a:b] for a, b in zip((offs[r] + first).tolist(), (offs[r] + last + length).tolist(), strict=True))
                for into, a in zip(got, (ids[lo:hi][r], first, last, anchor, span), strict=True):
                    into.append(a)
        if not got[0]:
            return
        tid, first, last, anchor, span = (np.concatenate(g) for g in got)
        del got
        _, pick, inverse, times = np.unique(span, return_index=True, return_inverse=True, return_counts=True)
        # equal digests under another anchor are other spans
        other = np.flatnonzero(anchor != anchor[pick][inverse])
        times -= np.bincount(inverse[other], minlength=len(times))
        settled = (times > 1)[inverse]
        settled[other] = False
        t, lo, end = _merged(tid[settled], first[settled], last[settled] + length)
        pick, many = np.concatenate([pick, other]), np.concatenate([times > 1, np.zeros(len(other), bool)]).astype(np.int64)
        tid, first, last, anchor, span = tid[pick], first[pick], last[pick], anchor[pick], span[pick]
        at = first << 32 | last << 1 | many
        for i in range(0, len(at), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[j].view(np.int64)), pa.array(span[j].view(np.int64)), pa.array(tid[j]), pa.array(at[j])], ["key", "span", "tid", "at"])
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.nulls(len(t), pa.int64()), pa.array(t), pa.array(lo << 32 | end << 1)], ["key", "span", "tid", "at"])

    return run


def _decided(length: int):
    """Rows by (key, span) to rows (key, tid, lo, hi, ask, known): ranges to cut (ask false), and spans to compare.

    A span is asked for if its anchor has another one too; ``known`` if it is repeated whole.
    """
    names = ["key", "tid", "lo", "hi", "ask", "known"]

    def out(key, tid, lo, hi, ask, known):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(tid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.full(len(key), ask)), pa.array(known)], names)

    def settle(key, span, tid, at, same_key: bool):
        """All rows of complete spans; ``same_key``: further spans of the first key came before, or of the last will come."""
        n = len(key)
        lo, hi, many = at >> 32, (at & 0xFFFFFFFF) >> 1, (at & 1).astype(bool)
        new_span = np.ones(n, bool)
        new_span[1:] = (span[1:] != span[:-1]) | (key[1:] != key[:-1])
        new_key = np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        s_at, k_at = np.flatnonzero(new_span), np.flatnonzero(new_key)
        whole = (np.add.reduceat(np.ones(n, np.int64), s_at) > 1) | np.logical_or.reduceat(many, s_at)
        cut = whole[np.cumsum(new_span) - 1]
        yield out(key[cut], tid[cut], lo[cut], hi[cut] + length, False, np.ones(cut.sum(), bool))
        spans = np.add.reduceat(new_span.astype(np.int64), k_at)
        several = spans > 1
        if same_key:
            several[[0, -1]] = True
        ask = s_at[several[np.cumsum(new_key)[s_at] - 1]]
        yield out(key[ask], tid[ask], lo[ask], hi[ask], True, whole[np.searchsorted(s_at, ask)])

    def run(batches):
        held, open_key = None, False
        for b in batches:
            none = np.asarray(b.column(1).is_null())
            cols = [c.fill_null(0).to_numpy() for c in b.columns]
            if none.any():
                t, at = cols[2][none], cols[3][none]
                yield out(t, t, at >> 32, (at & 0xFFFFFFFF) >> 1, False, np.ones(len(t), bool))
                cols = [c[~none] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, span = cols[0], cols[1]
            cut = int(np.searchsorted(key, key[-1])) if not open_key or key[0] != key[-1] else 0
            if cut:
                yield from settle(*[c[:cut] for c in cols], False) if not open_key else settle_open([c[:cut] for c in cols])
                open_key = False
                cols = [c[cut:] for c in cols]
            if len(cols[0]) > 500_000:  # one anchor, very often: settle the spans that are complete
                cut = int(np.searchsorted(cols[1], cols[1][-1]))
                if cut:
                    yield from settle(*[c[:cut] for c in cols], True)
                    cols, open_key = [c[cut:] for c in cols], True
                else:  # one span, very often
                    at = cols[3]
                    yield out(cols[0][2:], cols[2][2:], at[2:] >> 32, ((at[2:] & 0xFFFFFFFF) >> 1) + length, False, np.ones(len(at) - 2, bool))
                    cols = [c[:2] for c in cols]
            held = cols
        if held is not None and len(held[0]):
            yield from settle(*held, False) if not open_key else settle_open(held)

    def settle_open(cols):
        """The first key's spans have been asked for already in part; the other keys are complete."""
        end = int(np.searchsorted(cols[0], cols[0][0], side="right"))
        yield from settle(*[c[:end] for c in cols], True)
        if end < len(cols[0]):
            yield from settle(*[c[end:] for c in cols], False)

    return run


class Suffixes:
    """Suffixes of one buffer compared by common extension up to ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.sums = X.prefix_hash(data)
        self.inverse = X.powers(len(data) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.sums[a + mid] - self.sums[a]) * self.inverse[a] == (self.sums[b + mid] - self.sums[b]) * self.inverse[b]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        at = np.minimum(n, self.length - 1)
        return (n < self.length) & (self.data[a + at] < self.data[b + at])

    def sort(self, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Order of suffixes by class, then by their first ``length`` bytes: a bottom-up mergesort of all classes at once."""
        order = np.argsort(cls, kind="stable")
        sorted_cls = cls[order]
        new = np.flatnonzero(np.concatenate([[True], sorted_cls[1:] != sorted_cls[:-1]]))
        size = np.diff(np.append(new, len(order)))
        begin, total = np.repeat(new, size), np.repeat(size, size)
        index = np.arange(len(order)) - begin
        width = 1
        while len(size) and width < size.max():
            pair = index // (2 * width) * (2 * width)
            mid = np.minimum(pair + width, total)
            end = np.minimum(pair + 2 * width, total)
            left = index < mid
            busy = np.flatnonzero(mid < end)  # runs with a partner
            lo = np.where(left, mid, pair)[busy] + begin[busy]
            hi = np.where(left, end, mid)[busy] + begin[busy]
            first, own, is_left = lo.copy(), at[order[busy]], left[busy]
            while (todo := np.flatnonzero(lo < hi)).size:
                m = (lo[todo] + hi[todo]) >> 1
                other = at[order[m]]
                # left elements come before equal right ones
                right_of = np.where(is_left[todo], self.less(other, own[todo]), ~self.less(own[todo], other))
                lo[todo] = np.where(right_of, m + 1, lo[todo])
                hi[todo] = np.where(right_of, hi[todo], m)
            to = np.arange(len(order))
            rank = np.where(is_left, index[busy] - pair[busy], index[busy] - mid[busy]) + (lo - first)
            to[busy] = begin[busy] + pair[busy] + rank
            moved = np.empty_like(order)
            moved[to] = order
            order = moved
            width *= 2
        return order

    def repeated(self, at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each suffix shares its first bytes with another of its class, and which stand for the distinct ones."""
        order = self.sort(at, cls)
        a, b = at[order[:-1]], at[order[1:]]
        same = (cls[order[:-1]] == cls[order[1:]]) & (self.common(a, b) >= self.length)
        hits = np.flatnonzero(same)
        for i in range(0, len(hits), 20_000):  # hashes may collide, bytes do not
            part = hits[i : i + 20_000]
            span = np.arange(self.length)
            same[part] = (self.data[a[part][:, None] + span] == self.data[b[part][:, None] + span]).all(axis=1)
        out, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
        out[order[:-1]] |= same
        out[order[1:]] |= same
        first[order] = np.concatenate([[True], ~same]) if len(order) else []
        return out, first


def _compared(length: int, most: int):
    """Rows (key, tid, lo, hi, known, bytes) by key to rows (tid, lo, hi, key, window, known): ranges, or (window not null) windows left over."""
    names = ["tid", "lo", "hi", "key", "window", "known"]

    def sorted_part(rows: list[tuple], left_over: bool):
        keys = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in rows))}
        raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])
        lo = np.array([r[2] for r in rows], np.int64)
        n = np.array([r[3] for r in rows], np.int64) - lo + 1
        known = np.array([r[4] for r in rows], bool)
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[row] + step
        # the distance to the anchor: each row's windows share it, so it is found in the row's own bytes
        _, _, _, place, _ = _one_anchor(raw, begin, length)
        cls = np.array([keys[r[0]] for r in rows])[row] * 1024 + place[row] - step
        s = Suffixes(raw, length)
        rep, first = s.repeated(at, cls)
        tid = np.array([r[1] for r in rows], np.int64)
        hit = rep & ~known[row]
        w = (lo[row] + step)[hit]
        t, a, b = _merged(tid[row][hit], w, w + length)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64()), pa.array(np.ones(len(t), bool))], names)
        if left_over:
            at, r, i = at[first], row[first], step[first]
            whole = raw.tobytes()
            h = digests(whole[i : i + length] for i in at.tolist())
            own = np.array([r[0] for r in rows], np.int64)[r]
            yield pa.RecordBatch.from_arrays([pa.array(tid[r]), pa.array((lo[r] + i).astype(np.int32)), pa.array((lo[r] + i + length).astype(np.int32)), pa.array(own), pa.array(h.view(np.int64)), pa.array(rep[first] | known[r])], names)

    def run(batches):
        rows: list[tuple] = []
        long_key = None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) >= most:
                    if rows[0][0] == r[0] or rows[0][0] == long_key:  # one anchor fills the part, or the end of one that did
                        long_key = rows[0][0]
                        mine = [x for x in rows if x[0] == long_key]
                        yield from sorted_part(mine, True)
                        rows = rows[len(mine) :]
                    else:
                        full = [x for x in rows if x[0] != r[0]]
                        yield from sorted_part(full, False)
                        rows = rows[len(full) :]
                rows.append(r)
        mine = [x for x in rows if x[0] == long_key]
        if mine:
            yield from sorted_part(mine, True)
        if len(mine) < len(rows):
            yield from sorted_part(rows[len(mine) :], False)

    return run


def _one_anchor(raw: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of byte strings whose windows all have the same one: one entry a string."""
    got = _anchors(raw, begin, length)
    if len(got[0]) != len(begin) - 1:
        raise ValueError("a span has more than one anchor")
    return got


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(tid, text) of the distinct texts named by ``ids``; each task passes a text on once."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ids))  # FILTER_BITS bits

    def near(batches):
        m, met = bits.value, set()
        for b in batches:
            tid = b.column(0).to_numpy()
            h = X.mix(tid.astype(np.uint64)) & U(FILTER_BITS - 1)
            ok = (m[(h >> U(3)).astype(np.int64)] >> (7 - (h & U(7))).astype(np.uint8) & 1).astype(bool)
            ok[ok] = [not (t in met or met.add(t)) for t in tid[ok].tolist()]
            yield b.filter(pa.array(ok))

    return docs.select("tid", "text").mapInArrow(releasing(near), "tid long, text string").join(ids, "tid", "left_semi")


def _pieces(length: int):
    """Rows (tid, text, asks) to rows (key, tid, lo, hi, known, bytes)."""

    def run(batches):
        met: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            for tid, text, asks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if tid not in met:
                    met.add(tid)
                    raw = text.as_buffer().to_pybytes()
                    out.extend((a["key"], tid, a["lo"], a["hi"], a["known"], raw[a["lo"] : a["hi"] + length]) for a in asks)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["key", "tid", "lo", "hi", "known", "bytes"])

    return run


def repeated_ranges(docs: DataFrame, length: int = 200, group: int = GROUP) -> DataFrame:
    """(tid, lo, hi): byte ranges, overlapping or not, that cover the repeated bytes of each text; ``docs`` has tid and text."""
    found = docs.where(F.octet_length("text") >= length).select("tid", "text").mapInArrow(releasing(_found(length)), "key long, span long, tid long, at long")
    found = found.repartition("key").sortWithinPartitions("key", "span")
    sure = written(found.mapInArrow(releasing(_decided(length)), "key long, tid long, lo int, hi int, ask boolean, known boolean"), "decided")
    asks = sure.where("ask").groupBy("tid").agg(F.collect_list(F.struct("key", "lo", "hi", "known")).alias("asks"))  # of one text
    asks = written(asks, "asks")
    got = texts_of(docs, asks.select("tid")).join(asks, "tid").select("tid", "text", "asks").mapInArrow(releasing(_pieces(length)), "key long, tid long, lo int, hi int, known boolean, bytes binary")
    got = got.repartition("key").sortWithinPartitions("key", "tid", "lo")
    more = written(got.mapInArrow(releasing(_compared(length, group)), "tid long, lo int, hi int, key long, window long, known boolean"), "compared")
    # windows of groups that were sorted in parts
    left = more.where(F.col("window").isNotNull())
    twice = left.groupBy("key", "window").agg(F.count("*").alias("c"), F.max("known").alias("k")).where("c > 1")
    across = left.where("NOT known").join(twice.select("key", "window"), ["key", "window"], "left_semi").select("tid", "lo", "hi")
    ends = more.where(F.col("window").isNull()).select("tid", "lo", "hi")
    return sure.where("NOT ask").select("tid", "lo", "hi").union(ends).union(across)


def _cut(batches):
    """Rows (tid, text, ranges) to rows (tid, n_removed, n_spans, kept)."""
    for b in batches:
        out = []
        for tid, text, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            lo, hi = np.array([r["lo"] for r in ranges], np.int64), np.array([r["hi"] for r in ranges], np.int64)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            gone = np.cumsum(edge[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((tid, int(gone.sum()), runs, raw[~gone].tobytes()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["tid", "n_removed", "n_spans", "kept"])


def with_tid(docs: DataFrame, text: str) -> DataFrame:
    """``tid``, a 64-bit number of each distinct text: a hash; texts whose hashes collide, as SHA-256 tells, get another one."""
    tid, digest = text_hash(F.col(text)), F.sha2(text, 256)
    same = docs.select(tid.alias("tid"), F.unhex(digest).alias("d")).groupBy("tid").agg((F.min("d") != F.max("d")).alias("c")).where("c").select("tid")
    same = written(same, "collisions")
    docs = docs.withColumn("tid", tid)
    if same.isEmpty():
        return docs
    other = docs.join(same.withColumn("_c", F.lit(True)), "tid", "left")
    return other.withColumn("tid", F.when(F.col("_c"), F.xxhash64(digest)).otherwise(F.col("tid"))).select(*docs.columns)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def without_repeats(docs: DataFrame, length: int = 200, text: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with tid and null text read as empty, (tid, n_removed, n_spans, kept) of each text that loses bytes)."""
    docs = with_tid(empty_texts(docs, text), text)
    plain = docs.select("tid", F.col(text).alias("text"))
    ranges = repeated_ranges(plain, length, group).groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # of one text
    ranges = written(ranges, "ranges")
    cut = texts_of(plain, ranges.select("tid")).dropDuplicates(["tid"]).join(ranges, "tid").select("tid", "text", "ranges")
    return docs, cut.mapInArrow(releasing(_cut), "tid long, n_removed long, n_spans long, kept binary")


def op7_suffixes(spark: SparkSession, sf_dir: str, group: int = GROUP) -> DataFrame:
    """What every document keeps without its repeated 200-byte strings."""
    docs, cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), group=group)
    cut = written(cut.select("tid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "cut")
    rows = docs.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_whole"))
    out = rows.join(cut, "tid", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))


QUERIES = {"op7_suffixes": op7_suffixes}
SQL: dict[str, str] = {}
