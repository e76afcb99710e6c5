"""Quality rules with n-gram perplexity.

Base measures of a text are counts over its words, lines and characters.  On top of them
a language model judges it: an interpolated modified Kneser-Ney model of ``ORDER`` code
points for each language (ASCII letters in lower case, digits alike, blanks alike), learned
from the texts that pass the base rules.  Spark counts the n-grams of all of them, and from
the distinct n-grams of each order the numbers of their different beginnings, which are the
counts of the next lower order.  Discounts come from the counts of counts of a language and order.

No n-gram is dropped.  Spark joins the orders, from the lowest up, into the probability of each
n-gram of the highest order that any text has; n-grams that only texts have which fail the base
rules count 0 and are in it too.  The most frequent n-grams, ``MOST_SENT`` at most, go to
all tasks as one array of sorted hashes; the others of a text are written beside its measures,
meet their probabilities by a join and are added by text.  Logarithms are whole numbers of
``UNIT``, so that sums do not depend on their order, nor on which n-grams were sent.

Each language has its own band of perplexity.  From the log perplexities of all its texts
that pass the base rules come their median and median absolute deviation; a text is
rejected if it lies more than ``WIDTH`` deviations below or above the median, where short texts
are allowed what their length makes likely (the band widens with 1 / sqrt(length)).

Null text is empty; a text without words fails the base rules; an empty text has no
perplexity.  A null language is a language of its own.  Repeated rows count as often as they
occur.  An empty table gives an empty result; extra columns are ignored.  Texts are used whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm import text as X
from panelspark.llm.shared import empty_texts, releasing, table, written

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
WIDTH = (8.0, 8.0)
SHORT = 400
ORDER = 5
MOST_SENT = 1 << 18  # n-grams that all tasks get
UNIT = 2.0**-32  # of log10 probabilities
MOST_BROADCAST = 100_000
OUT = 200_000  # rows of an Arrow batch
HELD = 1 << 20  # n-grams that a task holds
MOST_TABLE = 1 << 24  # places of a table that numbers codes
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), [*SYMBOLS.encode()])

U = np.uint64
_BITS = 21  # of a code point and one more
_ONE = (1 << _BITS) - 1
#: Code points below 128 as the model sees them.
_PLAIN = np.arange(128)
_PLAIN[65:91] += 32
_PLAIN[48:58] = 48
_PLAIN[[9, 10, 11, 12, 13]] = 32


def _numbered(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, all below ``size``, and the number of each row's code: by a table of ``size``, or hashed by Arrow where that is long."""
    if size > MOST_TABLE:
        coded = pa.array(code).dictionary_encode()
        return coded.dictionary.to_numpy(), coded.indices.to_numpy()
    there = np.zeros(size, bool)
    there[code] = True
    own = np.flatnonzero(there)
    number = np.empty(size, np.int32)
    number[own] = np.arange(len(own))
    return own, number[code]


def _grams(data: np.ndarray, offs: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, hi, lo) of the distinct n-grams, which of them ends at each code point, and how many code points each row has.

    An n-gram has three of its ORDER code points in ``lo``, and 0 for what is before the text.  It is numbered by the
    number of what comes before its last code point and by that code point's own, from order 1 up.
    """
    lead, point = X.code_points(data)
    size = np.diff(np.searchsorted(lead, offs))
    own, point = _numbered(point, 0x110000)
    letters, letter = np.unique(np.where(own < 128, _PLAIN[np.minimum(own, 127)], own) + 1, return_inverse=True)
    letters, many = np.concatenate([[0], letters]), len(letters) + 1
    # ORDER - 1 zeros before each row, so that no n-gram reaches into the row before
    pad = ORDER - 1
    at = np.arange(len(point)) + np.repeat(pad * np.arange(1, len(size) + 1), size)
    padded = np.zeros(len(point) + pad * len(size), np.int32)
    padded[at] = (letter.astype(np.int32) + 1)[point]
    kinds, lang = np.unique(langs, return_inverse=True)
    number, count, levels = np.repeat(lang.astype(np.int32), size + pad), len(kinds), []
    for k in range(ORDER):
        # from order 2 on the number of the n-gram before; the array starts with the first place that has one
        code = (number[:-1] if k else number).astype(np.int32 if count * many <= MOST_TABLE else np.int64) * many + padded[k:]
        own, number = _numbered(code if k < pad else code[at - pad], count * many)
        levels.append(own)
        count = len(own)
    hi, lo = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    which = np.arange(count)
    for i, own in enumerate(reversed(levels)):
        which, last = np.divmod(own[which], many)
        (lo if i < 3 else hi)[:] |= letters[last].astype(np.uint64) << U(_BITS * (i % 3))
    return kinds[which], hi, lo, number, size


def _key(l: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64-bit hash of a language and an n-gram."""
    return X.mix(lo * U(0x9FB21C651E98DF25) ^ X.mix(hi * U(0xD6E8FEB86659FD93) + l.astype(np.int64).view(np.uint64)))


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct key, the number of each row's key); hashed by Arrow, which takes a fraction of a sort."""
    number = pa.array(key).dictionary_encode().indices.to_numpy()
    pick = np.empty(number.max(initial=-1) + 1, np.int64)
    pick[number[::-1]] = np.arange(len(key) - 1, -1, -1)
    return pick, number


def _summed(l: np.ndarray, hi: np.ndarray, lo: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-grams and their summed counts."""
    pick, inverse = _distinct(_key(l, hi, lo))
    return l[pick], hi[pick], lo[pick], *[np.bincount(inverse, n, minlength=len(pick)).astype(np.int64) for n in counts]


def count(docs: DataFrame) -> DataFrame:
    """(l, hi, lo, n, m): how often an n-gram occurs in the rows (text, l) that pass the base rules, and in all; l is a language's hash."""

    def out(l, hi, lo, n, m):
        for i in range(0, len(l), OUT):
            j = slice(i, i + OUT)
            yield pa.RecordBatch.from_arrays([pa.array(x[j].view(np.int64)) for x in (l, hi, lo, n, m)], ["l", "hi", "lo", "n", "m"])

    def run(batches):
        got: list[tuple] = []
        for b in batches:
            langs = b.column(1).to_numpy()
            for row, end, data, offs in X.slices(b.column(0)):
                if not len(data):
                    continue
                l, hi, lo, number, chars = _grams(data, offs, langs[row:end])
                good = np.repeat(~failed(*repeats(data, offs)[:2]), chars)
                got.append((l, hi, lo, *(np.bincount(x, minlength=len(l)) for x in (number[good], number))))
                if sum(len(g[0]) for g in got) > HELD:
                    got = [_summed(*(np.concatenate(x) for x in zip(*got, strict=True)))]
                    if len(got[0][0]) > HELD // 2:
                        yield from out(*got.pop())
        if got:
            yield from out(*_summed(*(np.concatenate(x) for x in zip(*got, strict=True))))

    rows = docs.select("text", "l").mapInArrow(releasing(run), "l long, hi long, lo long, n long, m long")
    return rows.groupBy("l", "hi", "lo").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _last(order: int) -> tuple[Column, Column]:
    """(hi, lo) of the last ``order`` code points of an n-gram."""
    masks = (1 << _BITS * max(order - 3, 0)) - 1, (1 << _BITS * min(order, 3)) - 1
    return F.col("hi").bitwiseAND(F.lit(masks[0]).cast("long")).alias("hi"), F.col("lo").bitwiseAND(F.lit(masks[1]).cast("long")).alias("lo")


def _context() -> tuple[Column, Column]:
    """(hi, lo) of an n-gram without its last code point."""
    lo = F.shiftright("lo", _BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(_ONE).cast("long")), 2 * _BITS))
    return F.shiftright("hi", _BITS).alias("chi"), lo.alias("clo")


def discounted(counts: DataFrame) -> DataFrame:
    """(k, l, hi, lo, m, alpha, gamma) of all n-grams (k, l, hi, lo, n, m): own probability, and back-off weight of the context."""
    n = F.col("n")
    stats = counts.groupBy("k", "l").agg(*[F.count_if(n == i).cast("double").alias(f"_n{i}") for i in (1, 2, 3, 4)])
    # a row a language and order
    y = F.col("_n1") / (F.col("_n1") + 2 * F.col("_n2"))
    ok = (F.col("_n1") > 0) & (F.col("_n2") > 0) & (F.col("_n3") > 0)
    cut = [F.when(ok, F.least(F.greatest(i - (i + 1) * y * F.col(f"_n{i + 1}") / F.col(f"_n{i}"), F.lit(0.01)), F.lit(i - 0.01))).otherwise(i / 2) for i in (1, 2, 3)]
    stats = written(stats.select("k", "l", *[c.alias(f"_d{i}") for i, c in enumerate(cut, 1)]), "stats")
    if stats.count() <= MOST_BROADCAST:  # else Spark deals the rows out by language and order, and splits large ones
        stats = F.broadcast(stats)
    own = F.when(n == 0, 0.0).when(n == 1, F.col("_d1")).when(n == 2, F.col("_d2")).otherwise(F.col("_d3"))
    rows = counts.select("k", "l", "hi", "lo", "n", "m", *_context()).join(stats, ["k", "l"])
    by = Window.partitionBy("k", "l", "chi", "clo")
    rows = rows.withColumns({"_total": F.sum("n").over(by)} | {f"_c{i}": F.count_if(n == i if i < 3 else n > 2).over(by) for i in (1, 2, 3)})
    seen, lost = F.col("_total") > 0, F.col("_d1") * F.col("_c1") + F.col("_d2") * F.col("_c2") + F.col("_d3") * F.col("_c3")
    alpha, gamma = F.when(seen, (n - own) / F.col("_total")).otherwise(0.0), F.when(seen, lost / F.col("_total")).otherwise(1.0)
    return rows.select("k", "l", "hi", "lo", "m", alpha.alias("alpha"), gamma.alias("gamma"))


def fit(docs: DataFrame) -> DataFrame:
    """(l, hi, lo, m, log) of all n-grams of rows (text, l): how often one occurs, and the log10 probability of its last code point in UNITs."""
    top = written(count(docs), "grams")
    orders, c = [top.select(F.lit(ORDER).alias("k"), "l", "hi", "lo", "n", "m")], top
    for k in range(ORDER - 1, 0, -1):
        # how many different code points come before it
        c = c.groupBy("l", *_last(k)).agg(F.count_if(F.col("n") > 0).alias("n"))
        orders.append(c.select(F.lit(k).alias("k"), "l", "hi", "lo", "n", F.lit(None).cast("long").alias("m")))
    every = orders[0]
    for o in orders[1:]:
        every = every.union(o)
    every = written(every, "counts")
    rows = written(discounted(every), "model")
    kinds = every.where((F.col("k") == 1) & (F.col("n") > 0)).groupBy("l").agg((1 / (F.count("*") + 1)).alias("p"))
    # a language without a text that passes has no code points of its own
    below = rows.where("k = 1").select("l").distinct().join(kinds, "l", "left").select("l", F.coalesce("p", F.lit(1 / 0x110000)).alias("p"))
    on = ["l"]
    for k in range(1, ORDER + 1):
        hi, lo = _last(k - 1)
        # merged, since a broadcast of a lower order would take the driver tens of MB
        below = rows.where(F.col("k") == k).withColumns({"_hi": hi, "_lo": lo}).join(below.hint("merge") if k > 1 else below, on).select("l", "hi", "lo", "m", (F.col("alpha") + F.col("gamma") * F.col("p")).alias("p"))
        if k < ORDER:
            below, on = below.select("l", F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "p"), ["l", "_hi", "_lo"]
    return written(below.select("l", "hi", "lo", "m", F.round(F.log10("p") / UNIT).cast("long").alias("log")), "logs")


def least_sent(grams: DataFrame) -> int:
    """How often an n-gram occurs at least that all tasks get; at most MOST_SENT do."""
    sizes = grams.groupBy(F.floor(F.log2("m") * 16).alias("size")).agg(F.count("*").alias("n"), F.min("m").alias("m"))
    least, total = 1 << 62, 0
    for r in sorted(sizes.collect(), reverse=True):  # 16 rows a power of two
        total += r["n"]
        if total > MOST_SENT:
            break
        least = r["m"]
    return least


@dataclass
class Frequent:
    """Sorted hashes of n-grams and the log10 probabilities of their last code points in UNITs."""

    keys: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, grams: DataFrame) -> Frequent:
        l, hi, lo, log = (c.to_numpy() for c in grams.select("l", "hi", "lo", "log").toArrow().columns)  # not Python rows, which take the driver ten times as much
        key = _key(l, hi.view(np.uint64), lo.view(np.uint64))
        o = np.argsort(key)
        return cls(key[o], log[o])

    def found(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the hashes, 0 for those that are not here, and which are."""
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        here = self.keys[at] == asked
        return np.where(here, self.logs[at], 0), here


def failed(n_words, n_repeat_words):
    """The base rules: too few words, or too many in repeated windows."""
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_REPEATED)


def _counted(marks: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), offs))


def _by_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n)


def repeats(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_words and n_repeat_words of each row of a slice, and the start and end of each word."""
    n = len(offs) - 1
    h, starts, ends, first = X.word_hashes(data, offs, lower=False)
    # windows of words within one text
    words = np.diff(first)
    repeated = np.zeros(n, np.int64)
    w = X.ngram_hashes(h, WINDOW)
    word_row = np.repeat(np.arange(n), words)
    if len(w):
        at = np.flatnonzero(word_row[: len(w)] == word_row[WINDOW - 1 :])
        _, number = _distinct(X.mix(w[at] + word_row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        hit = at[np.bincount(number)[number] > 1]
        edge = np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + WINDOW, minlength=len(h) + 1)
        repeated = _by_row(word_row[np.cumsum(edge[:-1]) > 0], n)
    return words, repeated, starts, ends


def measures(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row of a slice."""
    n = len(offs) - 1
    if not len(data):
        return [np.zeros(n, np.int64)] * 5
    words, repeated, starts, ends = repeats(data, offs)
    rows_of_bytes = np.repeat(np.arange(n), np.diff(offs))
    chars = (~X.BLANK[data]) & ((data & 0xC0) != 0x80)
    symbols = _SYMBOL[data]
    # lines end at line ends and at the ends of texts
    stop = data == 10
    lines = np.zeros(n, np.int64)
    line_lo = np.unique(np.concatenate([offs[:-1][offs[1:] > offs[:-1]], np.flatnonzero(stop) + 1]))
    line_lo = line_lo[line_lo < len(data)]
    line_row = rows_of_bytes[line_lo]
    breaks = np.flatnonzero(stop)
    nxt = np.searchsorted(breaks, line_lo)
    line_hi = np.minimum(np.where(nxt < len(breaks), np.append(breaks, len(data))[nxt], len(data)), offs[line_row + 1])
    worded = np.searchsorted(starts, line_lo) < np.searchsorted(starts, line_hi)
    line_lo, line_hi, line_row = line_lo[worded], line_hi[worded], line_row[worded]
    if len(line_lo):
        lh = X.mix(X.string_hash(data, line_lo, line_hi) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        pick, _ = _distinct(lh)
        lines = _by_row(line_row, n) - _by_row(line_row[pick], n)
    return [words, _counted(chars, offs), _counted(symbols, offs), lines, repeated]


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, frequent: Frequent, key: str = "doc_id") -> DataFrame:
    """A row a text of rows (key, text, l): a number of its own, key, l, the five measures, n_chars and the summed logs of its frequent n-grams.

    Each other n-gram of a text has a row too: the text's number, l, hi, lo and how often it occurs there.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_SENT n-grams at most
    names = ["number", key, "l", *_FIELDS, "n_chars", "log", "hi", "lo", "times"]

    def run(batches):
        model, number = sent.value, TaskContext.get().partitionId() << 40
        for b in batches:
            langs = b.column(2).to_numpy()
            for row, end, data, offs in X.slices(b.column(1)):
                n = end - row
                l, hi, lo, inverse, chars = _grams(data, offs, langs[row:end])
                logs, here = model.found(_key(l, hi, lo))
                sums, ends = np.concatenate([[0], np.cumsum(logs[inverse])]), np.cumsum(chars)
                own = [np.arange(number, number + n), *measures(data, offs), chars, sums[ends] - sums[ends - chars]]
                own = [pa.array(x.astype(np.int64)) for x in own]
                yield pa.RecordBatch.from_arrays([own[0], b.column(0).slice(row, n), b.column(2).slice(row, n), *own[1:], *[pa.nulls(n, pa.int64())] * 3], names)
                at = np.flatnonzero(~here[inverse])
                pairs, times = np.unique(np.repeat(np.arange(n), chars)[at] * len(l) + inverse[at], return_counts=True)
                for i in range(0, len(pairs), OUT):
                    text, gram = np.divmod(pairs[i : i + OUT], len(l))
                    none = pa.nulls(len(gram), pa.int64())
                    cols = [pa.array(x) for x in (text + number, l[gram], hi[gram].view(np.int64), lo[gram].view(np.int64), times[i : i + OUT])]
                    yield pa.RecordBatch.from_arrays([cols[0], pa.nulls(len(gram), b.schema.field(0).type), cols[1], *[none] * (len(_FIELDS) + 2), *cols[2:]], names)
                number += n

    kind = dict(docs.dtypes)[key]
    longs = ", ".join(f"{f} long" for f in names[2:])
    return docs.select(key, "text", "l").mapInArrow(releasing(run), f"number long, `{key}` {kind}, {longs}")


def scored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, l, the five measures, n_chars and log10 perplexity (null for an empty text) of rows (key, text, l)."""
    grams = fit(docs)
    least = least_sent(grams)
    rows = written(measured(docs, Frequent.of(grams.where(F.col("m") >= least)), key), "measures")
    others = rows.where("hi IS NOT NULL").select("number", "l", "hi", "lo", "times").join(grams.where(F.col("m") < least).hint("merge"), ["l", "hi", "lo"])
    others = others.groupBy("number").agg(F.sum(F.col("times") * F.col("log")).alias("others"))
    rows = rows.where("hi IS NULL").drop("hi", "lo", "times").join(others, "number", "left")
    total = F.col("log") + F.coalesce("others", F.lit(0))
    rows = rows.withColumn("log_perplexity", F.when(F.col("n_chars") > 0, -total * UNIT / F.col("n_chars")))
    return written(rows.drop("number", "log", "others"), "scored")


def judged(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the measures, base_failed, perplexity, its band (lower, upper) and kept."""
    docs = empty_texts(docs.select(key, "text", F.xxhash64(F.coalesce("lang", F.lit(""))).alias("l")))
    rows = scored(docs, key)
    rows = rows.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    good = rows.where("NOT base_failed")
    middle = written(good.groupBy("l").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")), "middle")
    spread = good.join(middle, "l").groupBy("l").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000).alias("spread"))
    bands = written(middle.join(spread, "l"), "bands")  # a row a language
    out = rows.join(bands, "l", "left")
    unit = F.greatest(F.col("spread"), F.lit(0.002)) * F.sqrt(1 + SHORT / F.greatest("n_chars", F.lit(1)))
    low, high = F.col("middle") - WIDTH[0] * unit, F.col("middle") + WIDTH[1] * unit
    inside = F.col("log_perplexity").between(low, high)
    bounds = [F.pow(F.lit(10.0), low).alias("lower"), F.pow(F.lit(10.0), high).alias("upper")]
    return out.select(key, *_FIELDS, "base_failed", F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"), *bounds, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judged(table(spark, sf_dir, "documents")).drop("lower", "upper")


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
