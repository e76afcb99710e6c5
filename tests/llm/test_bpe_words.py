"""The encoder's work on words: each distinct word of a task is worked out once, and remembered steps change nothing."""

import random

from tokenizers import Tokenizer

from panelspark.llm import bpe


def test_words_are_worked_out_once(monkeypatch):
    spec = bpe.default_spec()
    lib, rnd = Tokenizer.from_str(spec), random.Random(6)
    words = ["".join(rnd.choice("aeinorstlABC'é你!1\x1cσ") for _ in range(rnd.randint(1, 12))) for _ in range(150_000)]
    texts = [" ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)] * 2
    asked, encode_words = [], bpe.Bpe.encode_words
    monkeypatch.setattr(bpe.Bpe, "encode_words", lambda self, ws: asked.extend(ws) or encode_words(self, ws))
    own = bpe.Encoder(spec)
    for t in texts:  # over 100,000 distinct words between a word and its return
        assert next(own.encode([t])) == lib.encode(t, add_special_tokens=False).ids
    assert len(asked) == len(set(asked))


def test_steps_are_bounded(monkeypatch):
    spec = bpe.default_spec()
    lib, rnd = Tokenizer.from_str(spec), random.Random(7)
    texts = [" ".join("".join(rnd.choice("thequickbrownfxjumpsvlazydg") for _ in range(9)) for _ in range(3000)) for _ in range(3)]
    for more in (0, 1000, 1 << 20):
        own = bpe.Encoder(spec)
        monkeypatch.setattr(bpe, "MOST_STEPS", len(own.bpe.step) + more, raising=False)
        before = len(own.bpe.step)
        for t in texts:
            assert next(own.encode([t])) == lib.encode(t, add_special_tokens=False).ids
        assert 0 <= len(own.bpe.step) - before <= more and (not more or len(own.bpe.step) > before)


def test_words_that_were_forgotten(monkeypatch):
    spec = bpe.default_spec()
    lib, rnd = Tokenizer.from_str(spec), random.Random(9)
    words = ["".join(rnd.choice("aeinorst é你") for _ in range(rnd.randint(1, 7))) for _ in range(4000)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 300)
    own = bpe.Encoder(spec)
    for _ in range(60):
        t = " ".join(rnd.choice(words) for _ in range(200))
        assert next(own.encode([t])) == lib.encode(t, add_special_tokens=False).ids
