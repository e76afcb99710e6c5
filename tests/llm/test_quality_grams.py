"""Distinct n-grams of a slice, numbered by tables or by hashes, against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import quality
from panelspark.llm import text as X


def plain(c):
    c = ord(c)
    return int(quality._PLAIN[c]) if c < 128 else c


@pytest.mark.parametrize("table", [1 << 24, 40, 0])
def test_grams_of_a_slice(monkeypatch, table):
    monkeypatch.setattr(quality, "MOST_TABLE", table)
    rnd = random.Random(12)
    texts = ["", None, " ", "a", "AaA aAa", "12\t34\n", "é你🙂\U0010ffff\x00", ""] + ["".join(rnd.choice("abZ 7\n#é你🙂") for _ in range(rnd.randint(0, 80))) for _ in range(120)]
    langs = np.array([rnd.choice([-(1 << 62), 0, 7]) for _ in texts])
    ((row, end, data, offs),) = X.slices(pa.array(texts, pa.string()))
    l, hi, lo, number, size = quality._grams(data, offs, langs[row:end])
    want = []
    for t, lang in zip(texts, langs.tolist(), strict=True):
        codes = [0] * 4 + [plain(c) + 1 for c in t or ""]
        want += [(lang, sum(x << 21 * i for i, x in enumerate(codes[at - 4 : at + 1][::-1]))) for at in range(4, len(codes))]
    grams = [(a, int(b) << 63 | int(c)) for a, b, c in zip(l.tolist(), hi.tolist(), lo.tolist(), strict=True)]
    assert [grams[i] for i in number.tolist()] == want and size.tolist() == [len(t or "") for t in texts]
    assert len(set(grams)) == len(grams) and Counter(want).keys() == set(grams)


def test_no_text():
    none = np.zeros(0, np.uint8)
    for rows in (1, 3):
        got = quality._grams(none, np.zeros(rows + 1, np.int64), np.zeros(rows, np.int64))
        assert [len(x) for x in got] == [0, 0, 0, 0, rows]
