"""LM scoring by deleted interpolation.

The probability of a token w after u is

    l2[b] * c(u w) / c(u) + l1[b] * c(w) / N + l0[b] / (V + 1),

maximum-likelihood estimates mixed by weights that depend on the bucket b of how often
the context u occurs (powers of two).  The weights are learned by expectation-maximisation
on held-out counts: a fixed part of the training documents is left out of the counts, the
estimates of its tokens are collected in a histogram of bounded size, and EM runs on that.
Scoring then uses the counts of all training documents.

N-gram tables grow with the corpus and are never gathered anywhere.  Documents are packed
in chunks (about the size of an input split).  A chunk sends its distinct n-grams, as
packed arrays of hashes with counts, to the buckets of a hash space; a bucket adds up the
counts of all chunks and answers each with the totals in the order it asked; chunk and
answers meet again and its documents are scored.  So each n-gram crosses the network once
a chunk in either direction, in about seven bytes.  The number of buckets follows the
number of distinct n-grams, so that a bucket stays at about ``PER_BUCKET`` of them; a
chunk sends a row to each bucket that it has an n-gram for, so rows never outnumber
n-grams.  A task holds one chunk or one bucket at a time.

Words are lower-cased (A-Z) runs of non-blank characters; each text ends with one end
token, and its first token follows a start context.  Null and empty texts are one end
token.  Words and bigrams are told apart by 64-bit hashes: with 10**12 distinct bigrams
one that never occurred finds a count once in 18 million.
Documents with a null id belong to training as the empty id does.  Rows that repeat are
counted and scored each.  An empty table gives an empty result; without training tokens
every estimate is uniform.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import text as X
from panelspark.llm.langid import bucket
from panelspark.llm.shared import empty_texts, free, releasing, table, written

CHUNK_BYTES = 8 << 20
PER_BUCKET = 1_000_000
CONTEXTS = 24
GRID = 16  # histogram steps to one natural logarithm
END = np.uint64(0xE0D0E0D0E0D0E0D1)
START = np.uint64(0x57A2757A2757A271)
TRAIN, HELD, TEST = 0, 1, 2
U = np.uint64


def _pack(a: np.ndarray, width: int) -> bytes:
    """Little-endian integers as compressed byte planes."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zlib.compress(planes.tobytes(), 1)


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _pack_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys by their differences."""
    gaps = np.diff(keys, prepend=U(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return width, _pack(gaps, width)


def _pack_counts(n: np.ndarray) -> tuple[int, bytes]:
    width = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
    return width, _pack(n, width)


def chunks(docs: DataFrame) -> DataFrame:
    """One row a chunk: chunk, ids, folds, first (each document's first token, end), vocab (sorted word hashes), tokens (their places in it), n_pairs."""

    def packed(number, ids, folds, hashes, sizes):
        words = np.concatenate(hashes)
        vocab, tokens = np.unique(words, return_inverse=True)
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        width, packed_vocab = _pack_keys(vocab)
        pairs = len(np.unique(_pair_keys(vocab, tokens, first)))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(first) - 1], pa.int32()), pa.concat_arrays(ids)), pa.array([np.concatenate(folds)], pa.list_(pa.int8())), pa.array([first], pa.list_(pa.int32())),
             pa.array([width], pa.int32()), pa.array([packed_vocab], pa.binary()), pa.array([_pack(tokens, 4)], pa.binary()), pa.array([pairs], pa.int64()), pa.array([bool((np.concatenate(folds) == HELD).any())])],
            ["chunk", "ids", "folds", "first", "width", "vocab", "tokens", "n_pairs", "held"])

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held: list = [[], [], [], []]
        size = 0
        for b in batches:
            ids, folds = b.column(0), b.column(1).to_numpy()
            for lo, hi, data, offs in X.slices(b.column(2)):
                h, _, _, first = X.word_hashes(data, offs)
                n = np.diff(first)
                with_end = np.empty(len(h) + hi - lo, np.uint64)
                ends = np.cumsum(n + 1) - 1
                at = np.ones(len(with_end), bool)
                at[ends] = False
                with_end[at], with_end[ends] = h, END
                for into, x in zip(held, (ids.slice(lo, hi - lo), folds[lo:hi], with_end, n + 1), strict=True):
                    into.append(x)
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield packed(number, *held)
                    number, held, size = number + 1, [[], [], [], []], 0
        if held[0]:
            yield packed(number, *held)

    # ids stand for rows inside a chunk only; a null id comes back null
    return docs.mapInArrow(releasing(run), "chunk long, ids array<long>, folds array<byte>, first array<int>, width int, vocab binary, tokens binary, n_pairs long, held boolean")


def _pair_keys(vocab: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each token with the one before it."""
    h = vocab[tokens]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = START
    return X.mix(before * U(0x9FB21C651E98DF25) + h)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vocab = np.cumsum(_unpack(row["vocab"], row["width"]), dtype=np.uint64)
    return vocab, _unpack(row["tokens"], 4).astype(np.int64), np.array(row["first"], np.int64), np.array(row["folds"])


_ASK = "bucket int, kind int, chunk long, n int, key_width int, keys binary, main_width int, main binary, held_width int, held binary"


def _asks(n_buckets: int):
    """Chunks to their distinct uni- and bigrams by bucket, with counts in training and held-out documents."""

    def run(batches):
        for b in batches:
            b = b.select(["chunk", "folds", "first", "width", "vocab", "tokens"])
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                vocab, tokens, first, folds = _open(row)
                fold = np.repeat(folds, np.diff(first))
                pair_keys, pairs = np.unique(_pair_keys(vocab, tokens, first), return_inverse=True)
                out = []
                for kind, keys, which in ((1, vocab, tokens), (2, pair_keys, pairs)):
                    main = np.bincount(which[fold == TRAIN], minlength=len(keys))
                    held = np.bincount(which[fold == HELD], minlength=len(keys))
                    to = ((keys >> U(32)) * U(n_buckets)) >> U(32)
                    cut = np.searchsorted(to, np.arange(n_buckets + 1, dtype=np.uint64))
                    for to_bucket in np.flatnonzero(np.diff(cut)):
                        j = slice(cut[to_bucket], cut[to_bucket + 1])
                        out.append((int(to_bucket), kind, row["chunk"], int(cut[to_bucket + 1] - cut[to_bucket]), *_pack_keys(keys[j]), *_pack_counts(main[j]), *_pack_counts(held[j])))
                names = [f.split()[0] for f in _ASK.split(", ")]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return run


_ANSWER = "chunk long, kind int, bucket int, main_width int, main binary, full_width int, full binary, main_total long, total long, types long"


def _answer(group: pa.Table) -> pa.Table:
    """The asks of one bucket and kind to its answers; chunk -1 bears the bucket's totals."""
    rows = group.to_pylist()
    keys = [np.cumsum(_unpack(r["keys"], r["key_width"]), dtype=np.uint64) for r in rows]
    main = np.concatenate([_unpack(r["main"], r["main_width"]) for r in rows]).astype(np.int64)
    held = np.concatenate([_unpack(r["held"], r["held_width"]) for r in rows]).astype(np.int64)
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    # sums of whole numbers far below 2**53 are exact
    main_sum = np.bincount(which, main).astype(np.int64)
    full_sum = main_sum + np.bincount(which, held).astype(np.int64)
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        w = which[at : at + len(k)]
        at += len(k)
        out.append((r["chunk"], r["kind"], r["bucket"], *_pack_counts(main_sum[w]), *_pack_counts(full_sum[w]), None, None, None))
    free()
    out.append((-1, rows[0]["kind"], rows[0]["bucket"], None, None, None, None, int(main_sum.sum()), int(full_sum.sum()), int((full_sum > 0).sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in _ANSWER.split(", ")])


def _estimates(chunk: pa.Table, answers: pa.Table, which: str):
    """A chunk's row, its documents' first tokens and folds, and for each token c(w), c(u), c(u w)."""
    row = chunk.to_pylist()[0]
    vocab, tokens, first, folds = _open(row)
    got = {1: [], 2: []}
    for r in sorted(answers.select(["kind", "bucket", which, f"{which}_width"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"])):
        got[r["kind"]].append(_unpack(r[which], r[f"{which}_width"]).astype(np.int64))
    uni, bi = np.concatenate(got[1]), np.concatenate(got[2])
    _, pairs = np.unique(_pair_keys(vocab, tokens, first), return_inverse=True)
    c_w = uni[tokens]
    c_u = np.empty_like(c_w)
    c_u[1:] = c_w[:-1]
    # a start context comes once a document, as the end token does
    c_u[first[:-1]] = uni[np.searchsorted(vocab, END)]
    return row, first, folds, c_w, c_u, bi[pairs]


def _context(c_u: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c_u.astype(np.float64))[1], CONTEXTS - 1)


def _histogram(n_main: int):
    """Held-out tokens by context bucket and rounded log estimates."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["b", "q2", "q1", "n"]
        if not chunk.num_rows:
            return pa.table([pa.array([], pa.int32())] * 3 + [pa.array([], pa.int64())], names=names)
        _, first, folds, c_w, c_u, c_uw = _estimates(chunk, answers, "main")
        held = np.repeat(folds, np.diff(first)) == HELD
        c_w, c_u, c_uw = c_w[held], c_u[held], c_uw[held]
        q2 = np.where(c_uw > 0, np.rint(GRID * np.log(np.maximum(c_uw, 1) / np.maximum(c_u, 1))), 1).astype(np.int64)
        q1 = np.where(c_w > 0, np.rint(GRID * np.log(np.maximum(c_w, 1) / max(n_main, 1))), 1).astype(np.int64)
        cells, n = np.unique(np.stack([_context(c_u), q2, q1]), axis=1, return_counts=True)
        return pa.table([pa.array(c.astype(np.int32)) for c in cells] + [pa.array(n.astype(np.int64))], names=names)

    return run


def em(hist: np.ndarray, n_types: int, rounds: int = 60) -> np.ndarray:
    """Weights (context bucket x bigram, unigram, uniform) that fit the held-out histogram rows (b, q2, q1, n)."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not len(hist):
        return weights
    b, q2, q1, n = hist.T
    parts = np.stack([np.where(q2 > 0, 0, np.exp(np.minimum(q2, 0) / GRID)), np.where(q1 > 0, 0, np.exp(np.minimum(q1, 0) / GRID)), np.full(len(b), 1 / (n_types + 1))], axis=1)
    for _ in range(rounds):
        share = weights[b] * parts
        share *= (n / share.sum(axis=1))[:, None]
        got = np.stack([np.bincount(b, share[:, i], minlength=CONTEXTS) for i in range(3)], axis=1)
        total = got.sum(axis=1, keepdims=True)
        # a little of the prior keeps unseen buckets proper
        weights = (got + 0.5 * weights) / (total + 0.5)
    return weights


_SCORED = "doc_id long, fold byte, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(n: int, v: int, weights: np.ndarray):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _SCORED.split(", ")]
        if not chunk.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        row, first, folds, c_w, c_u, c_uw = _estimates(chunk, answers, "full")
        base = np.log10((c_w + 0.5) / (n + 0.5 * (v + 1)))
        w = weights[_context(c_u)]
        p = w[:, 0] * c_uw / np.maximum(c_u, 1) + w[:, 1] * c_w / max(n, 1) + w[:, 2] / (v + 1)
        # what a context that never occurred cannot give goes to the uniform part
        p += np.where(c_u == 0, w[:, 0], 0) / (v + 1) + (w[:, 1] / (v + 1) if n == 0 else 0)
        at = first[:-1]
        free()
        return pa.table(
            [pa.array(row["ids"], pa.int64()), pa.array(folds.astype(np.int8)), pa.array(np.diff(first)), pa.array(np.add.reduceat((c_w > 0).astype(np.int64), at)), pa.array(np.full(len(at), n)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
            names=names)

    return run


def lm_scores(docs: DataFrame, fold: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fold, n_tokens, n_known, train_tokens, base_score, score); ``fold`` is TRAIN, HELD (training, kept from the counts while weights are learned) or TEST."""
    rows = empty_texts(docs.select(F.col(key).cast("long").alias("id"), fold.cast("byte").alias("fold"), F.col(text).alias("text")))
    packed = written(chunks(rows), "chunks")
    n_pairs = packed.agg(F.sum("n_pairs")).first()[0] or 0
    n_buckets = max(8, -(-n_pairs // PER_BUCKET))
    asks = packed.mapInArrow(releasing(_asks(n_buckets)), _ASK)
    answers = written(asks.groupBy("bucket", "kind").applyInArrow(_answer, _ANSWER), "answers")
    n_main, n, v = (x or 0 for x in answers.where("chunk = -1 AND kind = 1").agg(F.sum("main_total"), F.sum("total"), F.sum("types")).first())
    answers = answers.where("chunk <> -1").select("chunk", "kind", "bucket", "main_width", "main", "full_width", "full")
    held = packed.where("held")
    for_held = answers.drop("full_width", "full").join(held.select("chunk"), "chunk", "left_semi")
    pairs = held.groupBy("chunk").cogroup(for_held.groupBy("chunk"))
    hist = pairs.applyInArrow(_histogram(n_main), "b int, q2 int, q1 int, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))
    weights = em(hist.toPandas().to_numpy(np.int64), v)  # a histogram of fixed grid
    scored = packed.groupBy("chunk").cogroup(answers.drop("main_width", "main").groupBy("chunk")).applyInArrow(_scored(n, v, weights), _SCORED)
    return scored.withColumnRenamed("doc_id", key) if key != "doc_id" else scored


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; held out are those with remainder 1."""
    docs = table(spark, sf_dir, "documents")
    fold = F.when(bucket(F.col("doc_id"), 5) == 1, TEST).when(bucket(F.col("doc_id"), 50) == 0, HELD).otherwise(TRAIN)
    out = lm_scores(docs, fold)
    return out.select("doc_id", (F.col("fold") == TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm": op6_lm}
SQL: dict[str, str] = {}
