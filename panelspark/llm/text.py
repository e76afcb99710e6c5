"""Vectorised text primitives used inside tasks.

Everything here works on the raw UTF-8 buffers of Arrow string columns, a few
megabytes at a time, so a task's memory does not depend on how many rows an
Arrow batch holds.  Words are runs of characters other than the blanks
``\\x20`` and ``\\x09``-``\\x0D``; these are single bytes in UTF-8 and never part
of a longer sequence, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_U = np.uint64
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (int(_BASE), _inverse(int(_BASE))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and number of each code point of valid UTF-8."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int64)
    point = b.copy()
    long = np.flatnonzero(b >= 0xC0)  # of more than one byte
    if len(long):
        c, last = b[long], len(data) - 1
        one, two, three = (data[np.minimum(lead[long] + i, last)].astype(np.int64) & 0x3F for i in (1, 2, 3))
        point[long] = np.where(c < 0xE0, (c & 0x1F) << 6 | one, np.where(c < 0xF0, (c & 0xF) << 12 | one << 6 | two, np.minimum((c & 0x7) << 18 | one << 12 | two << 6 | three, 0x10FFFF)))
    return lead, point


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~BLANK[data]
    full = offs[1:] > offs[:-1]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~word[:-1]
    first[offs[:-1][full]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~word[1:]
    last[offs[1:][full] - 1] = True
    starts = np.flatnonzero(word & first)
    return starts, np.flatnonzero(word & last) + 1, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = hash of bytes i..j times base**i; one longer than the data."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums."""
    _, q = powers(len(sums))
    h = (sums[ends] - sums[starts]) * q[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def string_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span as a string of its own: mixed blocks up to 16 bytes, BLAKE2b beyond.

    A polynomial over all bytes would be cheaper, but modulo 2**64 there are pairs of
    strings (a Thue-Morse word and its complement) on which it agrees whatever its base.
    """
    size = ends - starts
    if not len(size):
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    blocks = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    h = mix((blocks[starts] & _TAIL[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    two = np.flatnonzero((size > 8) & (size <= 16))
    h[two] = mix(h[two] * _U(0x9FB21C651E98DF25) + (blocks[starts[two] + 8] & _TAIL[size[two] - 8]))
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        sums = [blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        h[long] = np.frombuffer(b"".join(sums), "<u8")
    return h


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word with its start and end, and each row's first word index."""
    starts, ends, first = word_spans(data, offs)
    return string_hash(LOWER[data] if lower else data, starts, ends), starts, ends, first


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct hashes of k-word shingles; fewer words count as one shingle; no words, none."""
    h, _, _, first = word_hashes(data, offs)
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = mix(s * _U(0x9FB21C651E98DF25) + h[i : i + n])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = mix(one * _U(0x9FB21C651E98DF25) + x)
            yield one
        else:
            yield np.empty(0, np.uint64)


def ngram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the runs of k consecutive word hashes (len(h) - k + 1 of them)."""
    n = max(0, len(h) - k + 1)
    s = np.full(n, salt + k, np.uint64)
    for i in range(k):
        s = mix(s * _U(0x9FB21C651E98DF25) + h[i : i + n])
    return s
