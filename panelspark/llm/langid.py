"""Language identification of mixed text: script ranges, per-word scores, Viterbi.

Training counts, for every language, hashed byte n-grams (1 to 4 bytes, with a mark at
both ends of a word) and words by script, over all labelled rows; Spark sums the counts
and the model is a table of ``SLOTS`` rows and a column a language, so its size does not
depend on the data; with more than 128 languages slots are folded so that it keeps to
``CELLS`` numbers.  Prediction scores each word by naive Bayes over its n-grams among
the languages that use the word's script, then finds the best labelling of the whole
sequence of words where each change of language costs ``PENALTY``: spans of mixed text
come out as runs of one label.  Words that are sure to keep their label
cut the sequence, and where running sums show that no stretch of other labels is worth its
changes the step-by-step search is left out (``best_labels``).  A document's language is the one with most of its
lettered words (on ties the first by code point); its score is that share.

A letter is any character of the Unicode categories L*; those outside the listed blocks
are of the script "letters", which narrows no languages.

Null text, text without a letter and an empty model give ``und`` with score 0; words
without letters count for no language.  Texts of any length are labelled whole: the
sequence step runs over all documents of a slice at once.  Rows are independent of each
other, so repeated rows repeat their result.  Extra columns are kept; those named like a result
column are replaced, and ``names`` gives the results other names.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import text as X
from panelspark.llm.shared import releasing, table, written

SLOTS = 1 << 16
GRAMS = (1, 2, 3, 4)
PENALTY = 12.0
CELLS = 1 << 23
HELD = 32  # languages a task counts at a time
UNKNOWN = "und"
SLICE = 512 << 10
#: Scripts by code block (fixed values): first and last code point of ranges whose letters belong to it; other letters are "letters".
BLOCKS = (
    ("Latin", 0x0, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0x2C60, 0x2C7F), ("Latin", 0xA720, 0xA7FF), ("Latin", 0xAB30, 0xAB6F), ("Latin", 0xFB00, 0xFB06), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Cyrillic", 0x1C80, 0x1C8F), ("Cyrillic", 0xA640, 0xA69F), ("Armenian", 0x530, 0x58F), ("Armenian", 0xFB13, 0xFB17),
    ("Hebrew", 0x590, 0x5FF), ("Hebrew", 0xFB1D, 0xFB4F), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Arabic", 0x870, 0x8FF), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFE),
    ("Syriac", 0x700, 0x74F), ("Thaana", 0x780, 0x7BF), ("Nko", 0x7C0, 0x7FF), ("Devanagari", 0x900, 0x97F), ("Devanagari", 0xA8E0, 0xA8FF), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F),
    ("Gujarati", 0xA80, 0xAFF), ("Oriya", 0xB00, 0xB7F), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF),
    ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF), ("Myanmar", 0x1000, 0x109F), ("Myanmar", 0xA9E0, 0xA9FF), ("Myanmar", 0xAA60, 0xAA7F), ("Georgian", 0x10A0, 0x10FF),
    ("Georgian", 0x1C90, 0x1CBF), ("Georgian", 0x2D00, 0x2D2F), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0x3130, 0x318F), ("Hangul", 0xA960, 0xA97F), ("Hangul", 0xAC00, 0xD7FF), ("Hangul", 0xFFA0, 0xFFDC),
    ("Ethiopic", 0x1200, 0x139F), ("Ethiopic", 0x2D80, 0x2DDF), ("Ethiopic", 0xAB00, 0xAB2F), ("Cherokee", 0x13A0, 0x13FF), ("Cherokee", 0xAB70, 0xABBF), ("Syllabics", 0x1400, 0x167F),
    ("Syllabics", 0x18B0, 0x18FF), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF), ("Kana", 0x3040, 0x30FF), ("Kana", 0x31F0, 0x31FF), ("Kana", 0xFF66, 0xFF9D), ("Kana", 0x1B000, 0x1B16F),
    ("Bopomofo", 0x3100, 0x312F), ("Bopomofo", 0x31A0, 0x31BF), ("Han", 0x3005, 0x3007), ("Han", 0x3400, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x3FFFF), ("Yi", 0xA000, 0xA4CF),
)
#: The script of letters outside all blocks; it narrows no languages.
ANY = "letters"
_NAMES = sorted({n for n, _, _ in BLOCKS} | {ANY})


def _letters() -> np.ndarray:
    """Script of every code point, -1 where it is not a letter (categories L*)."""
    out = np.full(0x110000, -1, np.int8)
    out[[c for c in range(0x40000) if unicodedata.category(chr(c))[0] == "L"]] = _NAMES.index(ANY)
    for name, first, last in BLOCKS:
        part = out[first : last + 1]
        part[part >= 0] = _NAMES.index(name)
    return out


_SCRIPT = _letters()


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = X.LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[up] += 0x20
    return out


def _scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word: that of its first letter; -1 for words without letters."""
    lead, point = X.code_points(data)
    kind = _SCRIPT[point]
    lettered = kind >= 0
    where, kind = lead[lettered], kind[lettered]
    at = np.searchsorted(where, starts)
    out = np.full(len(starts), -1)
    inside = at < len(where)
    inside[inside] = where[at[inside]] < ends[inside]
    out[inside] = kind[at[inside]]
    return out


@dataclass
class Words:
    """The words of a slice: distinct lettered words with their n-gram slots, and the sequence of all words."""

    first: np.ndarray  # row -> its first word
    which: np.ndarray  # word -> its distinct word, -1 without letters
    slots: np.ndarray  # slots of all distinct words, one after the other
    bounds: np.ndarray  # distinct word -> its first slot
    script: np.ndarray  # distinct word -> script


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    low = _lower(data) if len(data) else data
    starts, ends, first = X.word_spans(low, offs)
    script = _scripts(low, starts, ends)
    lettered = np.flatnonzero(script >= 0)
    which = np.full(len(starts), -1)
    if not len(lettered):
        none = np.empty(0, np.int64)
        return Words(first, which, none, none, none)
    h = X.span_hash(X.prefix_hash(low), starts[lettered], ends[lettered])
    _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
    which[lettered] = inverse
    pick = lettered[pick]
    size = ends[pick] - starts[pick] + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(pick)), size)
    at = np.arange(begin[-1]) - begin[word]
    marks = (at == 0) | (at == size[word] - 1)
    chars = np.where(marks, 0, low[np.minimum(starts[pick][word] + at - 1, len(low) - 1)]).astype(np.uint64)
    codes, owner = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        code = np.full(len(chars) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(257) + chars[i : len(chars) - n + 1 + i] + np.uint64(1)
        ok = word[: len(code)] == word[n - 1 :]
        codes.append((X.mix(code[ok]) & np.uint64(SLOTS - 1)).astype(np.int64))
        owner.append(word[: len(code)][ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    slots = np.concatenate(codes)[order]
    return Words(first, which, slots, np.searchsorted(owner[order], np.arange(len(pick))), script[pick])


def count(train: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, slot, n): n-gram counts, then (slot >= SLOTS) words by script, of all rows with text and language."""

    def run(batches):
        got: dict[str, np.ndarray] = {}

        def counted():
            for name, n in got.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "slot", "n"])
            got.clear()

        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for lo, hi, data, offs in X.slices(b.column(0), SLICE):
                w = words_of(data, offs)
                rows = np.repeat(np.arange(hi - lo), np.diff(w.first))
                grams = np.diff(np.append(w.bounds, len(w.slots)))
                for name in set(langs[lo:hi]):
                    mine = w.which[(langs[lo:hi] == name)[rows]]
                    times = np.bincount(mine[mine >= 0], minlength=len(w.bounds))
                    into = got.setdefault(name, np.zeros(SLOTS + len(_NAMES)))
                    into[:SLOTS] += np.bincount(w.slots, np.repeat(times, grams), minlength=SLOTS)
                    into[SLOTS:] += np.bincount(w.script, times, minlength=len(_NAMES))
                    if len(got) >= HELD:
                        yield from counted()
        yield from counted()

    rows = train.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    return rows.mapInArrow(releasing(run), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray  # slot x language; the number of slots is a power of two
    allowed: np.ndarray  # script x language


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all labelled rows; at most CELLS numbers come to the driver, and a few for each language."""
    counts = written(count(train, text, lang), "langid")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    slots = SLOTS
    while slots > 1 and slots * len(langs) > CELLS:
        slots //= 2
    folded = F.when(F.col("slot") < SLOTS, F.col("slot") % slots).otherwise(F.col("slot") - SLOTS + slots).alias("slot")
    got = counts.groupBy("lang", folded).agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((slots + len(_NAMES), len(langs)))
    n[got["slot"], np.searchsorted(np.array(langs, dtype=object), got["lang"])] = got["n"]
    log = np.log((n[:slots] + 0.5) / (n[:slots].sum(axis=0) + 0.5 * slots)) if langs else n[:slots]
    words = n[slots:]
    allowed = words >= 0.001 * np.maximum(words.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    allowed[_NAMES.index(ANY)] = True
    return Model(langs, log.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word where a change costs ``penalty``; row r has the words first[r]..first[r+1].

    Step t handles word t of every row that is that long, rows being sorted by length.
    """
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    steps = int(size[0]) if len(size) else 0
    if not steps or k == 1:
        return out
    longer = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # rows with more than t words
    moved, best = np.zeros((n, k), bool), np.zeros(n, np.int64)
    value = scores[begin[: longer[0]]].copy()
    for t in range(1, steps):
        m = longer[t]
        value = value[:m]
        at = begin[:m] + t
        top = value.argmax(axis=1)
        change = value[np.arange(m), top][:, None] - penalty
        moved[at] = change > value
        best[at] = top
        value = np.maximum(value, change) + scores[at]
        if t + 1 == steps or longer[t + 1] < m:
            cut = longer[t + 1] if t + 1 < steps else 0
            out[at[cut:]] = value[cut:].argmax(axis=1)  # the rows that end here
    one = longer[1] if steps > 1 else 0
    ends_at_first = begin[one : longer[0]]
    out[ends_at_first] = scores[ends_at_first].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        at = begin[: longer[t]] + t
        label = out[at]
        out[at - 1] = np.where(moved[at, label], best[at], label)
    return out


def best_labels(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The labels that ``viterbi`` gives, with its steps kept to the words where they matter.

    A word whose best label leads the next one by over two changes has that label in every
    best sequence: taking it for that word alone would pay.  These words cut a row into
    pieces that do not depend on each other.  A piece takes the label of the words at its
    ends if they agree, and no stretch of other labels inside gains over two changes (at a
    row's own start or end: over one), even if each word took its best other label.
    """
    size, n = np.diff(first), len(scores)
    if not n or scores.shape[1] == 1:
        return np.zeros(n, np.int64)
    word, limit = np.arange(n), penalty - 1e-3
    top = scores.argmax(axis=1)
    others = scores.copy()
    others[word, top] = -np.inf
    fixed = scores[word, top] - others.max(axis=1) > 2 * penalty + 1e-3
    row_start = np.zeros(n, bool)
    row_start[first[:-1][size > 0]] = True
    at = np.flatnonzero(row_start | fixed)
    end = np.append(at[1:], n) - 1
    piece = np.repeat(np.arange(len(at)), end - at + 1)
    fixed_before = fixed[at]
    fixed_after = np.append(~row_start[at[1:]], False)
    after = np.append(top[at[1:]], 0)
    total = np.add.reduceat(scores, at, axis=0, dtype=np.float64).argmax(axis=1)
    own = np.where(fixed_before, top[at], np.where(fixed_after, after, total))
    mine = own[piece]
    others = scores.copy()
    others[word, mine] = -np.inf
    gain = np.maximum(others.max(axis=1) - scores[word, mine], -2 * penalty).astype(np.float64)
    upto = np.cumsum(gain) - 1e6 * piece  # the drop between pieces keeps stretches within a piece
    before = upto - gain
    sure = np.maximum.reduceat(upto - np.minimum.accumulate(before), at) <= 2 * limit
    sure &= fixed_before | (np.maximum.reduceat(upto, at) - before[at] <= limit)
    sure &= fixed_after | (upto[end] - np.minimum.reduceat(before, at) <= limit)
    sure &= ~(fixed_before & fixed_after) | (own == after)
    out = mine.astype(np.int64)
    left = np.flatnonzero(~sure)
    if len(left):
        length = end[left] - at[left] + 1 + fixed_after[left]
        begin = np.concatenate([[0], np.cumsum(length)])
        words = np.repeat(at[left] - begin[:-1], length) + np.arange(begin[-1])
        out[words] = viterbi(scores[words], begin, penalty)
    return out


def label_words(w: Words, model: Model, penalty: float) -> np.ndarray:
    """Language index of each word of a slice."""
    k = len(model.langs)
    scores = np.zeros((len(w.which), k), np.float32)
    if len(w.bounds):
        fold, ends = model.log.shape[0] - 1, np.append(w.bounds, len(w.slots))
        own = np.empty((len(w.bounds), k), np.float32)
        step = max(1, (1 << 18) // k)  # distinct words at a time
        for lo in range(0, len(w.bounds), step):
            hi = min(lo + step, len(w.bounds))
            own[lo:hi] = np.add.reduceat(model.log[w.slots[ends[lo] : ends[hi]] & fold], w.bounds[lo:hi] - ends[lo], axis=0)
        own = np.where(model.allowed[w.script], own, own.min() - 1e3).astype(np.float32)
        lettered = w.which >= 0
        own -= own.max(axis=1, keepdims=True)
        scores[lettered] = own[w.which[lettered]]
    return best_labels(scores, w.first, penalty)


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, keep_text: bool = True, names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """``docs`` (without the text, if so asked) with language, score and spans (array of lang, first word, end word) under ``names``."""
    keep = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers, whatever the data
    size = max(SLICE >> 6, SLICE * 16 // max(16, len(model.langs)))  # scores are words by languages

    def run(batches):
        model = sent.value
        k = max(1, len(model.langs))
        for b in batches:
            for lo, hi, data, offs in X.slices(b.column(text), size):
                w = words_of(data, offs)
                label = label_words(w, model, penalty) if model.langs else np.zeros(len(w.which), np.int64)
                rows = np.repeat(np.arange(hi - lo), np.diff(w.first))
                lettered = w.which >= 0
                share = np.bincount(rows[lettered] * k + label[lettered], minlength=(hi - lo) * k).reshape(hi - lo, k)
                total = share.sum(axis=1)
                known = np.flatnonzero(total > 0) if model.langs else []
                pred = np.full(hi - lo, UNKNOWN, dtype=object)
                score = np.zeros(hi - lo)
                top = share.argmax(axis=1)
                spans: list[list] = [[] for _ in range(hi - lo)]
                if len(known):
                    pred[known] = np.array(model.langs, dtype=object)[top[known]]
                    score[known] = share[known, top[known]] / total[known]
                    cut = np.ones(len(label), bool)
                    cut[1:] = (label[1:] != label[:-1]) | (rows[1:] != rows[:-1])
                    at = np.flatnonzero(cut)
                    for s, e in zip(at, np.append(at[1:], len(label)), strict=True):
                        r = rows[s]
                        if total[r]:
                            spans[r].append({"lang": model.langs[label[s]], "first": int(s - w.first[r]), "end": int(e - w.first[r])})
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score), pa.array(spans, kind)], [*keep, *names])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return docs.select(*keep, *([] if keep_text else [text])).mapInArrow(releasing(run), f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` array<struct<lang:string,first:int,end:int>>")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(bucket(F.col("doc_id"), 4) != 2))
    out = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op8_langid": op8_langid}
SQL: dict[str, str] = {}
