"""The quality model keeps every n-gram, whatever its share, and whichever of them the tasks get."""

import math
import random

import pytest

from panelspark.llm import quality
from tests.llm.test_corpus import SCHEMA, brute_perplexity


def test_no_ngram_is_dropped(spark, monkeypatch):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("aeinorstlé你") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    # of 700,000 n-grams one that occurs once is less than 2^-19
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(330)), "en", "a", 0) for i in range(330)]
    assert sum(len(r[1]) for r in rows) > 1 << 19
    rows += [(1000 + i, " ".join(rnd.choice(vocab) for _ in range(60)), "fr", "a", 0) for i in range(40)]
    rows += [(2000, "too few: zq#x", "en", "a", 0), (2001, "zq#x " * 40, "en", "a", 0), (2002, "bare", "de", "a", 0), (2003, None, "en", "a", 0), (2004, "", "de", "a", 0), (None, rows[3][1], "en", "a", 0)]
    want = {i: v for (i, _), v in brute_perplexity(rows).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    got = []
    for most in (1 << 20, 3000, 0):
        monkeypatch.setattr(quality, "MOST_SENT", most, raising=False)
        got.append({r["doc_id"]: r for r in quality.judged(df).collect()})
        assert got[-1].keys() == want.keys()
        for i, v in want.items():
            p = got[-1][i]["perplexity"]
            assert (p is None) == (v is None)
            if v is not None:
                assert math.log10(p) == pytest.approx(v, abs=1e-9)
    assert got[0] == got[1] == got[2]
