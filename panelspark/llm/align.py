"""Alignment of two tokenizers by merge-path partitioning of their token ends.

A text with a leading space is encoded by a byte-level BPE file (A) and by a sentence-piece
model (B, which adds that space itself).  Where a token of both ends at the same byte a
group ends; tokens of A and B link where their byte ranges overlap.

Both tokenizers divide a text at every space after a character that is no white space: the
split pattern of A has no token across it, and no piece of B holds a space behind another
character (checked when the model is loaded; otherwise texts are not divided).  So texts
are divided there, and what each distinct word gives is worked out once for as long as the
worker's memory holds it.

The token ends of all new words lie end to end, once for A and once for B.  The merge of the
two is cut by diagonals ``PIECE`` steps apart: a binary search on each diagonal tells how many
ends of A and of B come before it, so all pieces are equal in work and independent, however
unequal the words are.  Each piece walks its part of the merge path, all pieces in step, and
emits the overlaps and the group ends that it meets; counting the ends of the pieces before it
stitches the groups that reach over a border.

How many documents hold a pair of ids linked is counted over the whole corpus.  A task takes
documents by chunks of about ``CHUNK`` characters and writes, for each document, its distinct
pairs as numbers in its chunk, and the chunk's distinct pairs with their documents.  Only the
latter are summed up, joined with their totals and sent back to their chunk, where its
documents take what is theirs: what is shuffled for the counts are the distinct pairs of
chunks, not of documents, and a pair that every document holds is one row a chunk.

Texts that are null or empty, or whose tokens do not give back the text with its space (a
text with U+2581, say), have no tokens: zeros and an empty string of groups.  Texts of any length
are encoded whole, a run of about ``RUN`` characters at a time.  Rows that repeat count as
documents each; ids are only carried along and may be null.  An empty table gives an empty
result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelspark.llm.bpe import _batches, _byte_chars, tokenizer_spec
from panelspark.llm.shared import releasing, table, written

PIECE = 256
CHUNK = 1 << 23
RUN = 1 << 20
WORDS, WORD_BYTES = 200_000, 1 << 25  # of the memory of words
# How byte-level tokenizer files divide a text, and the pattern that this stands for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE_SPACE = re.compile(r"\s ")
_BORDER = re.compile(r"(?<=\S) ")


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) on each diagonal i + j = 0, piece, 2 * piece, ...: the ends of a and of b among the first i + j of both; equal ends of a come first."""
    k = np.arange(0, len(a) + len(b), piece)
    lo, hi = np.maximum(0, k - len(b)), np.minimum(k, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        before = np.zeros(len(k), bool)
        before[open_] = a[mid[open_]] <= b[k[open_] - 1 - mid[open_]]
        lo = np.where(open_ & before, mid + 1, lo)
        hi = np.where(open_ & ~before, mid, hi)
    return lo, k - lo


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (i, j) and group ends (i, j: tokens of a and of b before each) of two ascending arrays of token ends with the same last end."""
    i, j = diagonals(a, b, piece)
    pieces, total = len(i), len(a) + len(b)
    # past the last token there is nothing that ends or overlaps
    a_end, b_end = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    a_start, b_start = np.concatenate([[0], a]), np.concatenate([[0], b])
    steps = min(piece, total)
    at_i, at_j = np.empty((steps, pieces), np.int64), np.empty((steps, pieces), np.int64)
    link, ends = np.empty((steps, pieces), bool), np.empty((steps, pieces), bool)
    for s in range(steps):
        ea, eb, sa, sb = a_end[i], b_end[j], a_start[i], b_start[j]
        at_i[s], at_j[s] = i, j
        link[s] = (sa < eb) & (sb < ea)
        first = ea <= eb  # the end of a is the next one of the merge
        ends[s] = ~first & (sa == eb)  # b ends where a just ended
        live = i + j < total
        link[s] &= live
        ends[s] &= live
        i = np.where(live & first, i + 1, i)
        j = np.where(live & ~first, j + 1, j)
    # by piece and then by step: the order of the path, so that groups open at the end of a piece go on in the next
    order = [x.T.ravel() for x in (at_i, at_j, link, ends)]
    at_i, at_j, link, ends = order
    own = np.arange(pieces * steps) < total
    link, ends = link & own, ends & own
    return at_i[link], at_j[link], at_i[ends], at_j[ends] + 1


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: i for i, c in enumerate(_byte_chars())}
        spec = json.loads(a_spec)
        model = spec["model"]
        vocab = model["vocab"]
        self.a_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.divides = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_shown = np.array([b"%d%c" % (i, c) for i in range(len(self.a_bytes)) for c in b",|"], object)
        self.b_shown = np.array([b"%d%c" % (i, c) for i in range(len(self.b_bytes)) for c in b",;"], object)
        # where ids follow the order of the merges, the ids are the ranks, and a library that takes ranks gives the same ids sooner
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == BYTE_LEVEL | {"trim_offsets": spec["pre_tokenizer"].get("trim_offsets")}
        special = {t["content"] for t in spec.get("added_tokens") or []}
        self.ranks = None
        if self.divides and plain and all(x < y for x, y in zip(made, made[1:])):
            self.ranks = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={self.a_bytes[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})

    def encode_a(self, words: list[str]) -> np.ndarray:
        """The ids of words, each after a space, end to end."""
        if self.ranks is not None:
            return np.array(self.ranks.encode_ordinary("".join([" " + w for w in words])), np.int64)
        return np.fromiter(chain.from_iterable(e.ids for e in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)), np.int64)

    def encode_b(self, words: list[str]) -> np.ndarray:
        """The ids of words end to end; the model adds the space before each."""
        return np.fromiter(chain.from_iterable(self.b.encode(words, num_threads=1)), np.int64)

    def divided(self, text: str) -> list[str]:
        """The words of a text, each without the space before it."""
        if not self.divides:
            return [text]
        parts = _BORDER.split(text) if text[0] == " " or _BEFORE_SPACE.search(text) else text.split(" ")
        if parts[-1] == "" and len(parts) > 1:  # B encodes nothing as no token, also where a space is meant
            parts[-2:] = [parts[-2] + " "]
        return parts

    def runs(self, text: str) -> Iterator[list[str]]:
        """The words of a text by runs of about RUN characters."""
        lo = 0
        while self.divides and len(text) - lo > RUN:
            m = _BORDER.search(text, lo + RUN)
            if not m or m.end() == len(text):
                break
            yield self.divided(text[lo : m.start()])
            lo = m.end()
        yield self.divided(text[lo:] if lo else text)


class Words:
    """What is known of words: counts, group strings and linked pairs, by a number for each word."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # each group with its semicolon; None: the tokens do not give the word back
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.linked = np.zeros(0, np.int64)  # numbers of the pairs of all words end to end
        self.first = np.zeros(1, np.int64)
        self.pair_number: dict[int, int] = {}
        self.keys: list[int] = []
        self.bytes = 0

    def full(self) -> bool:
        return len(self.groups) > WORDS or self.bytes > WORD_BYTES

    def learn(self, words: list[str]) -> None:
        """Aligns words that are not known yet, all in one merge."""
        # B shows U+2581 for a space, so it does not give such words back
        words.sort(key=lambda w: "▁" in w)
        good = next((i for i, w in enumerate(words) if "▁" in w), len(words))
        try:
            self._learn(words[:good])
        except ValueError:
            for w in words[:good]:
                try:
                    self._learn([w])
                except ValueError:
                    self._add([w], np.zeros((1, 4), np.int64), [None])
        self._add(words[good:], np.zeros((len(words) - good, 4), np.int64), [None] * (len(words) - good))

    def _add(self, words: list[str], counts: np.ndarray, groups: list[bytes | None]) -> None:
        self.number.update(zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True))
        self.groups.extend(groups)
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[:, 3])])
        self.bytes += sum(len(g or b"") for g in groups) + 4 * sum(map(len, words))

    def _learn(self, words: list[str]) -> None:
        """Words that both tokenizers give back; otherwise a ValueError and nothing learned."""
        if not words:
            return
        p = self.pair
        a, b = p.encode_a(words), p.encode_b(words)
        whole = [(" " + w).encode() for w in words]
        all_words = b"".join(whole)
        if b"".join(map(p.a_bytes.__getitem__, a.tolist())) != all_words or b"".join(map(p.b_bytes.__getitem__, b.tolist())) != all_words:
            raise ValueError("tokens do not give the words back")
        word_end = np.cumsum([len(w) for w in whole])
        a_end, b_end = np.cumsum(p.a_size[a]), np.cumsum(p.b_size[b])
        i, j, end_i, end_j = merge_path(a_end, b_end)
        # each of these numbers is cut at the ends of words, which are group ends
        to_a, to_b, to_group = np.searchsorted(a_end, word_end) + 1, np.searchsorted(b_end, word_end) + 1, np.searchsorted(a_end[end_i - 1], word_end) + 1
        if not np.array_equal(end_i[to_group - 1], to_a):
            raise ValueError("a token crosses the border of a word")
        to_link = np.searchsorted(i, to_a)
        counts = np.diff(np.stack([to_a, to_b, to_group, to_link], axis=1), axis=0, prepend=0)
        key, back = np.unique(a[i] << 32 | b[j], return_inverse=True)
        number = self.pair_number
        new = [number.setdefault(k, len(number)) for k in key.tolist()]
        self.keys.extend(k for k, n in zip(key.tolist(), new, strict=True) if n >= len(self.keys))
        self.linked = np.concatenate([self.linked, np.array(new, np.int64)[back]])
        # ids with what follows them, in the order of the groups: those of A, then those of B
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_i - 1] = last_b[end_j - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.append(0, end_j)[group_a]] = p.a_shown[2 * a + last_a]
        shown[np.arange(len(b)) + end_i[group_b]] = p.b_shown[2 * b + last_b]
        shown, cut = shown.tolist(), [0, *(to_a + to_b).tolist()]
        self._add(words, counts, [b"".join(shown[x:y]) for x, y in zip(cut, cut[1:])])

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Word numbers of each text."""
        get = self.number.__getitem__
        self.learn(list({w for t in texts for w in t if w not in self.number}))
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def pairs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair number, times) of all pairs linked in the texts."""
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        word, times = np.unique(of << 32 | (np.concatenate(texts) if texts else of), return_counts=True)
        of, word = word >> 32, word & 0xFFFFFFFF
        size = self.counts[word, 3]
        total = np.cumsum(size)
        flat = np.arange(total[-1] if len(total) else 0) + np.repeat(self.first[word] - total + size, size)
        key, back = np.unique(np.repeat(of, size) << 32 | self.linked[flat], return_inverse=True)
        times = np.bincount(back, np.repeat(times, size), minlength=len(key)).astype(np.int64)
        return key >> 32, key & 0xFFFFFFFF, times


class Chunk:
    """The distinct pairs of a run of documents, numbered as they come, and how many documents hold each."""

    def __init__(self):
        self.local = np.full(0, -1, np.int64)
        self.keys: list[int] = []
        self.docs = np.zeros(0, np.int64)

    def take(self, words: Words, pairs: np.ndarray) -> np.ndarray:
        """Chunk numbers of pairs, each of which is one document's."""
        if len(self.local) < len(words.keys):
            self.local = np.concatenate([self.local, np.full(2 * len(words.keys) - len(self.local), -1, np.int64)])
        new = np.unique(pairs[self.local[pairs] < 0])
        self.local[new] = np.arange(len(self.keys), len(self.keys) + len(new))
        self.keys.extend(words.keys[i] for i in new.tolist())
        self.docs = np.concatenate([self.docs, np.zeros(len(new), np.int64)])
        got = self.local[pairs]
        self.docs += np.bincount(got, minlength=len(self.docs))
        return got


class _Aligner:
    """Texts to (n_a, n_b, n_groups, n_links), groups, and their distinct pairs with how often each is linked."""

    def __init__(self, pair: Pair, digest: bool):
        self.pair, self.words, self.digest = pair, Words(pair), digest

    def shown(self, numbers: list[np.ndarray]) -> str:
        get = self.words.groups.__getitem__
        if not self.digest:
            return b"".join([get(i) for n in numbers for i in n.tolist()]).decode()[:-1]
        h = hashlib.sha256()
        for k, n in enumerate(numbers, 1):
            part = b"".join(map(get, n.tolist()))
            h.update(part if k < len(numbers) else memoryview(part)[:-1])  # each group ends with a semicolon, the last one does not
        return h.hexdigest()

    def whole(self, numbers: np.ndarray) -> bool:
        return None not in map(self.words.groups.__getitem__, numbers.tolist())

    def align(self, texts: list[str]) -> tuple[list[tuple], list[str], list[tuple]]:
        """Counts, groups and pairs (numbers, times) of each text."""
        counts: list[tuple] = [(0, 0, 0, 0)] * len(texts)
        groups = [""] * len(texts)
        empty = np.zeros(0, np.int64)
        pairs: list[tuple] = [(empty, empty)] * len(texts)
        runs = {t: [self.words.numbers([r])[0] for r in self.pair.runs(x)] for t, x in enumerate(texts) if len(x) > RUN}
        short = [t for t, x in enumerate(texts) if x and len(x) <= RUN]
        runs |= {t: [n] for t, n in zip(short, self.words.numbers([self.pair.divided(texts[t]) for t in short]), strict=True)}
        for t in list(runs):
            if not all(map(self.whole, runs[t])):
                # some word is not given back: the text counts, not its words
                runs[t] = self.words.numbers([[texts[t]]])
                if not self.whole(runs[t][0]):
                    del runs[t]
        one = [t for t in runs if len(runs[t]) == 1]
        of, number, times = self.words.pairs([runs[t][0] for t in one])
        cut = np.searchsorted(of, np.arange(len(one) + 1))
        for k, t in enumerate(one):
            pairs[t] = number[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]]
        for t, numbers in runs.items():
            counts[t] = tuple(sum(self.words.counts[n].sum(axis=0) for n in numbers).tolist())
            groups[t] = self.shown(numbers)
            if len(numbers) > 1:
                parts = [self.words.pairs([n])[1:] for n in numbers]
                number, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                pairs[t] = number, np.bincount(back, np.concatenate([y for _, y in parts])).astype(np.int64)
        return counts, groups, pairs


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
_ROWS = f"chunk long, {_COUNTS}, groups string, at array<int>, times array<long>, pairs array<long>, docs array<long>"


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(kind)))


def aligned(docs: DataFrame, a_spec: str, b_model: bytes, key: str, text: str, digest: bool) -> DataFrame:
    """A row a document, with its pairs as numbers in its chunk (``pairs`` null), and a row a chunk with its distinct pairs."""
    sent = docs.sparkSession.sparkContext.broadcast((a_spec, b_model))  # two tokenizer files, whatever the data
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    names = ["id", *(x.split()[0] for x in _ROWS.split(", "))]

    def run(batches: Iterator) -> Iterator:
        aligner = _Aligner(Pair(*sent.value), digest)
        number, size, chunk = TaskContext.get().partitionId() << 32, 0, Chunk()

        def end() -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (to_arrow_type(kind), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([none[0], pa.array([number]), *none[1:], _lists([np.array(chunk.keys, np.int64)], np.int64), _lists([chunk.docs], np.int64)], names)

        for whole in batches:
            for b in _batches(whole, "text"):
                if size > CHUNK or aligner.words.full():
                    yield end()
                    if aligner.words.full():
                        aligner.words.clear()
                    number, size, chunk = number + 1, 0, Chunk()
                texts = [t or "" for t in b.column(1).to_pylist()]
                size += sum(map(len, texts))
                counts, groups, pairs = aligner.align(texts)
                at = chunk.take(aligner.words, np.concatenate([n for n, _ in pairs]))
                at = np.split(at, np.cumsum([len(n) for n, _ in pairs])[:-1])
                none = pa.nulls(len(texts), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(texts), number)), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(groups, pa.string()), _lists(at, np.int32), _lists([t for _, t in pairs], np.int64), none, none], names)
        yield end()

    return rows.mapInArrow(releasing(run), f"id {dict(rows.dtypes)['id']}, {_ROWS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether that is the most for its id of A."""
    each = rows.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = written(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")), "pairs")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row an id of A at most
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _counted(rows: DataFrame) -> DataFrame:
    """The documents of ``rows`` with n_best and count_sum: the pairs of each chunk get their counts, its documents read them there."""
    asked = rows.where("pairs IS NOT NULL").select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    told = asked.join(pair_counts(rows), "pair").select("chunk", F.lit(0).cast("byte").alias("kind"), "pos", "n", "best")
    kept = ["id", *(x.split()[0] for x in _COUNTS.split(", ")), "groups"]
    docs = rows.where("pairs IS NULL").select("chunk", F.lit(1).cast("byte").alias("kind"), *kept, "at", "times")
    both = told.unionByName(docs, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    kinds = dict(docs.dtypes)

    def run(batches: Iterator) -> Iterator:
        key, told, n, best = None, [], None, None
        for b in batches:
            chunk, kind = b.column("chunk").to_numpy(), b.column("kind").to_numpy()
            cut = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(chunk)], strict=True):
                if lo == hi:
                    continue
                if chunk[lo] != key:
                    key, told, n, best = chunk[lo], [], np.zeros(0, np.int64), np.zeros(0, bool)
                p = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    told.append([p.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "best")])
                    continue
                if told:
                    pos, counts, tops = (np.concatenate(x) for x in zip(*told, strict=True))
                    n, best, told = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool), []
                    n[pos], best[pos] = counts, tops
                at, times = (p.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "times"))
                ends = np.concatenate([[0], np.cumsum(p.column("at").value_lengths().to_numpy())])
                sums = [np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in kept), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], [*kept, "n_best", "count_sum"])

    return both.mapInArrow(releasing(run), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best long, count_sum long")


def cross_tokenizer(docs: DataFrame, a_spec: str, b_model: bytes, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3`` in ids of A and B, or with ``digest`` the SHA-256 of that.
    """
    rows = written(aligned(docs, a_spec, b_model, key, text, digest), "aligned")
    out = _counted(rows)
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def default_files() -> tuple[str, bytes]:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json")), f.read()


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers aligned over every whole text, with the corpus-wide counts of linked pairs."""
    out = cross_tokenizer(table(spark, sf_dir, "documents"), *default_files(), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_align": op12_align}
SQL: dict[str, str] = {}
