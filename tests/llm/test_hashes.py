"""Words on which polynomial hashes modulo 2**64 agree are different words for every operator."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import jaccard, lm, quality
from panelspark.llm import text as X
from tests.llm.test_corpus import WORD, table_dir


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    """The first n letters of the Thue-Morse word and of its complement."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


PAIRS = [thue_morse(n, a, b) for n, a, b in ((512, "a", "q"), (1024, "a", "b"), (2048, "x", "y"), (4096, "a", "q"))]


def test_distinct_strings_have_distinct_hashes():
    words = [w for p in PAIRS for w in p] + ["", "a", "a\0", "\0", "\0\0", "ab", "ba"] + ["x" * n for n in range(2, 40)]
    words += [f"{i}" for i in range(20_000)] + [f"prefix-{i}" for i in range(20_000)] + [f"a much longer word {i}" for i in range(5000)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = X.string_hash(data, ends - [len(w) for w in words], ends)
    assert len(np.unique(h)) == len(words)
    # where a string stands makes no difference
    again = X.string_hash(np.concatenate([np.full(5, 7, np.uint8), data]), ends - [len(w) for w in words] + 5, ends + 5)
    assert (h == again).all()
    assert (X.string_hash(data, ends[-1:] - 3, ends[-1:]) == X.string_hash(data[-3:], np.array([0]), np.array([3]))).all()


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(len(p[0])))
def test_jaccard_keeps_them_apart(spark, pair):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(pair, 1)] + [(3, pair[0].upper())], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_language_model_counts_them_apart(spark, tmp_path):
    def held(i):
        return zlib.crc32(str(i).encode()) % 5 == 1

    train = [i for i in range(60) if not held(i)]
    test = [i for i in range(60) if held(i)]
    rows = [(i, f"{PAIRS[k % 4][0]} plain words", "en", "a", 1) for k, i in enumerate(train)] + [(i, f"{PAIRS[k % 4][1]} plain", "en", "a", 1) for k, i in enumerate(test)]
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*WORD.findall(t.lower()), None])
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.op6_lm(spark, table_dir(spark, tmp_path, rows)).collect()}
    for i, t, *_ in rows:
        tokens = [*WORD.findall(t.lower()), None]
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens), rel_tol=1e-9)


def test_quality_measures_tell_their_lines_and_words_apart():
    for a, b in PAIRS:
        seven = " a b c d e f g"
        texts = [f"{a}\n{b}", f"{a}\n{a}", f"{a}{seven}\n{b}{seven}", f"{a}{seven}\n{a}{seven}"]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = quality.measures(data, offs)
        assert got[3].tolist() == [0, 1, 0, 1] and got[4].tolist() == [0, 0, 0, 16]
