"""Digests of texts from numbered words: equal to the library's, with tables made once."""

import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelspark.llm import bpe

ODD = ["", " ", " \t\n", "a", " a  b ", "a\n\r\x0b\x0cb", "a\xa0b　c\x85d e", "é e ́  x", "\x1ca\x1db\x1e \x1f", "ΑΣ Σ ΣΑΣ\nΣ", "İI ıi", "it's 'S 12a3",
       "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "<|ENDOFTEXT|> x", "\x00a\x00 b", "日本 語🙂🙂 x", "x" * 300, "w " * 900, "1\\E2 \\Q"]


def by_library(texts):
    lib = Tokenizer.from_str(bpe.default_spec())
    lib.no_truncation()
    lib.no_padding()
    ids = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    return [(len(x), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, x)), lib.decode(x, skip_special_tokens=False)))) for x in ids]


@pytest.mark.parametrize(("piece", "words"), [(1 << 18, 200_000), (7, 20), (1, 0)])
def test_digests(monkeypatch, piece, words):
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "CACHE_WORDS", words)
    rnd = random.Random(11)
    texts = ODD + ["".join(rnd.choice("aeinorstlABC'é你!1 \n\xa0Σ́") for _ in range(rnd.randint(0, 90))) for _ in range(300)]
    want, own = by_library(texts), bpe.encoder(bpe.packed(bpe.default_spec()))
    bpe._loaded.clear()
    got = [r for lo in range(0, len(texts), 64) for r in own.digests(pa.array(texts[lo : lo + 64]))]
    assert got == want
    assert own.digests(pa.array(texts).slice(5, 40)) == want[5:45] and own.digests(pa.array([], pa.string())) == []


def test_tasks_make_no_tables(monkeypatch):
    made, automaton = [], bpe.Bpe._automaton
    monkeypatch.setattr(bpe.Bpe, "_automaton", lambda self: made.append(1) or automaton(self))
    sent = bpe.packed(bpe.default_spec())
    for _ in range(2):  # as each task does
        own = bpe.encoder(sent)
        bpe._loaded.clear()
    assert len(made) == 1
    monkeypatch.setattr(own, "encode", None)  # no text is gone through word by word
    assert own.digests(pa.array(["the the\nsea"])) == by_library(["the the\nsea"])
