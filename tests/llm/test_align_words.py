"""Words that hold U+2581 beside others, in any order, without Spark."""

import random

from panelspark.llm import align


def test_words_after_one_with_the_mark():
    pair = align.Pair(*align.default_files())
    words = ["one▁two", "and", "more", "▁", "é", "0123456789abcdef" * 3, "x▁", "'s", "b"]
    alone = {}
    for w in words:
        own = align.Words(pair)
        own.learn([w])
        alone[w] = own.groups[0], own.counts[0].tolist()
    assert [w for w in words if alone[w][0] is None] == ["one▁two", "▁", "x▁"]
    for seed in range(20):
        random.Random(seed).shuffle(words)
        got = align.Words(pair)
        got.learn(list(words))
        assert {w: (got.groups[n], got.counts[n].tolist()) for w, n in got.number.items()} == alone


def test_texts_beside_one_with_the_mark():
    pair = align.Pair(*align.default_files())
    texts = ["one▁two and more", "and more of it", "▁ b", "b of them"]
    counts, groups, _ = align._Aligner(pair, digest=False).align(texts)
    assert [bool(g) for g in groups] == [False, True, False, True]
    for t, c in zip(texts[1::2], counts[1::2], strict=True):
        assert c[:2] == (len(pair.a.encode(" " + t, add_special_tokens=False).ids), len(pair.b.encode(t)))
