"""BPE encoding and decoding by a depth-first walk of a trie of distinct words.

The words of a batch (pre-tokens, each ending in a symbol with the end mark) that were
not met lately form a trie.  A walk down the trie keeps, for the prefix at each depth, the
last token of that prefix's encoding: the encoding of a prefix is the encoding of what
precedes its last token plus that token, so one number a depth is the whole state, and a
prefix that many words share is worked out once.  A token that ends the prefix is its last
token if it may follow the last token before it, that is, if no merge across their border
would have come before the merges that built the two.  Which tokens end a prefix is told
by the vocabulary's own trie with suffix links.

Encodings are those of the tokenizer file: NFC, white space to blanks, lower case, the
file's split pattern, byte symbols, merges by rank, and special tokens found in the raw
text first.  Decoding joins the tokens with blanks, as a file without a decoder asks.

Null text is empty: no tokens, and the hash of the empty string.  Text of any length is
encoded whole.  Rows are independent, so ties, repeated rows and empty tables need no
rule.  Other columns are kept; a column named like a result is an error, not replaced.
"""

from __future__ import annotations

import gc
import hashlib
import json
import pickle
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from panelspark.llm.shared import empty_texts, releasing, table

CACHE_WORDS = 200_000
MOST_STEPS = 400_000
PIECE = 1 << 18  # words whose ids are written at once
_SPACES = regex.compile("[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SENTINEL = 1 << 60


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Bpe:
    """A BPE vocabulary with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.chars = _byte_chars()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace("\\s", _SPACES.pattern[1:-2]))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = self.ids[a + b]
            self.rank[self.ids[a], self.ids[b]] = r
            if whole not in self.parts:
                self.parts[whole] = (self.ids[a], self.ids[b])
                self.made[whole] = r
        self._edges: tuple[dict, dict] = ({}, {})
        self._follows: dict[int, bool] = {}
        self._sounds: dict[int, bool] = {}
        # a symbol is a character, with the end mark if it is a word's last one
        self.symbols = {c: i for i, c in enumerate(self.chars)}
        self._automaton()
        self._edges, self._sounds = ({}, {}), {}

    def _automaton(self) -> None:
        """The vocabulary's trie, with a link from each node to the longest proper suffix that is a node too."""
        self.step: dict[int, int] = {}  # node << 9 | symbol -> node
        token, depth = [-1], [0]
        for t, i in self.ids.items():
            # a token that its own parts would not be merged into is never used
            if i in self.parts and not self._sound(i):
                continue
            ended = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            body = t[: -len(self.end)] if ended else t
            if any(c not in self.symbols for c in body):
                continue
            node = 0
            for d, c in enumerate(body, 1):
                key = node << 9 | self.symbols[c] | (ended and d == len(body)) << 8
                node = self.step.get(key)
                if node is None:
                    node = self.step[key] = len(token)
                    token.append(-1)
                    depth.append(d)
            token[node] = i
        self.link = [0] * len(token)
        self.ends: list[tuple | None] = [None] * len(token)  # (token, its length) of each suffix that is a token, long ones first
        edges = sorted(self.step.items(), key=lambda e: depth[e[1]])
        for key, node in edges:  # by depth, so that links of what is above are there
            if key >> 9:
                self.link[node] = self.after(self.link[key >> 9], key & 511)
            own = ((token[node], depth[node]),) if token[node] >= 0 else ()
            self.ends[node] = own + (self.ends[self.link[node]] or ())
        self.ends[0] = ()

    def after(self, node: int, symbol: int) -> int:
        """The node of the longest suffix that goes on with ``symbol``."""
        at = node
        while (to := self.step.get(at << 9 | symbol)) is None:
            if not at:
                return 0
            at = self.link[at]
        return to

    def _sound(self, token: int) -> bool:
        out = self._sounds.get(token)
        if out is None:
            a, b = self.parts[token]
            out = self._sounds[token] = all(p not in self.parts or self._sound(p) for p in (a, b)) and self._border(a, b, self.made[token])
        return out

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Symbols at one edge while ``token`` is built, with the ranks at which each appears and is used up."""
        out = self._edges[side].get(token)
        if out is None:
            out, until, t = [], _SENTINEL, token
            while True:
                since = self.made.get(t, -1)
                out.append((t, since, until))
                if t not in self.parts:
                    break
                until, t = since, self.parts[t][side]
            self._edges[side][token] = out
        return out

    def _border(self, left: int, right: int, limit: int = _SENTINEL) -> bool:
        """No merge across the border comes (before ``limit``) while its two symbols are there."""
        rank = self.rank.get
        for a, a_since, a_until in self._edge(left, 1):
            for b, b_since, b_until in self._edge(right, 0):
                r = rank((a, b))
                # of equal ranks the left one goes first
                if r is not None and r < limit and a_since < r < a_until and b_since < r <= b_until:
                    return False
        return True

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words in UTF-8 without the end mark; the symbol of a byte is its number.

        In sorted order the words are the trie's leaves as a depth-first walk meets them: a
        word goes on from the states of the prefix that it shares with the one before.
        """
        out: dict[bytes, tuple[int, ...]] = {}
        follows, border, ends, step, after = self._follows, self._border, self.ends, self.step, self.after
        if len(follows) > 200_000:
            follows.clear()
        # by depth: the vocabulary's node, the prefix's last token, and where that starts
        node, last, start = [0], [-1], [0]
        before: list[int] = []
        for w in sorted(words):
            own = list(w)
            own[-1] |= 256  # the last symbol bears the end mark
            n = 0
            for x, y in zip(before, own):
                if x != y:
                    break
                n += 1
            del node[n + 1 :], last[n + 1 :], start[n + 1 :]
            at, d = node[n], n
            for symbol in own[n:]:
                d += 1
                to = step.get(at << 9 | symbol)
                if to is None:
                    to = after(at, symbol)
                    if len(step) < MOST_STEPS:  # what a node goes on with by its links is its step from here on
                        step[at << 9 | symbol] = to
                at = to
                for token, size in ends[at]:
                    s = d - size
                    if s:
                        key = last[s] << 17 | token
                        ok = follows.get(key)
                        if ok is None:
                            ok = follows[key] = border(last[s], token)
                        if not ok:
                            continue
                    break
                else:
                    raise ValueError(f"no token ends at {w[:d]!r}")
                node.append(at)
                last.append(token)
                start.append(s)
            before, ids = own, []
            while d:
                ids.append(last[d])
                d = start[d]
            out[w] = tuple(ids[::-1])
        return out

    def words(self, text: str, split: regex.Pattern | None = None) -> list[str]:
        """Normalised pre-tokens.  White space only divides them, so turning runs of it to blanks changes nothing."""
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
        else:
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character by itself: no context rule for a final sigma
                text = text.replace("Σ", "σ")
        return (split or self.split).findall(text.lower())


@contextmanager
def _uncollected() -> Iterator[None]:
    """No cycles are made here, and Python would visit all remembered words to look for them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


_loaded: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts with a bounded cache of blank-delimited words; ``spec`` is the JSON of a tokenizer file.

    No token spans white space, so a text's encoding is that of its blank-delimited words
    one after the other.
    """

    def __init__(self, spec: str):
        self.bpe = Bpe(json.loads(spec))
        size = max(self.bpe.names, default=-1) + 1
        self.names = [self.bpe.names.get(i, "") for i in range(size)]
        self.decimals = [str(i) for i in range(size)]
        self.parts = Recent(CACHE_WORDS)  # pre-tokens in UTF-8 to their ids
        self.split = regex.compile(self.bpe.split.pattern + "|\n")
        self.any_special = "|".join("\\Q" + t + "\\E" for t in self.bpe.special)
        self.blank_names = pa.array([" " + x for x in self.names], pa.large_string())
        self.blank_decimals = pa.array([" " + x for x in self.decimals], pa.large_string())
        self.forget()

    def forget(self) -> None:
        """No word at ASCII blanks is known."""
        self.number: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids_of(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word.  Pre-tokens that were not met lately share one trie; only pre-tokens are remembered, as words would take as much memory again."""
        with _uncollected():
            bpe, parts = self.bpe, self.parts
            split = {w: [p.encode() for p in bpe.words(w)] for w in words}
            got = bpe.encode_words(parts.missing(set(chain.from_iterable(split.values()))))
            known = parts.new
            known.update(got)
            return {w: known[ps[0]] if len(ps) == 1 else tuple([i for p in ps for i in known[p]]) for w, ps in split.items()}

    def _number(self, words: list[str]) -> np.ndarray:
        """A number of each distinct word, whose ids are ``flat`` from ``first`` of it on."""
        number = self.number
        new = [w for w in words if w not in number]
        if new:
            bpe, parts = self.bpe, self.parts
            # a line end, which no word holds, goes through as a part of its own and ends each word
            coded = pa.array(bpe.words("\n".join(["\n", *new, ""]), self.split)).dictionary_encode()
            code, own = coded.indices.to_numpy(), [p.encode() for p in coded.dictionary.to_numpy(zero_copy_only=False)]
            got = bpe.encode_words(parts.missing({*own[1:]}))
            parts.new.update(got)
            ids = [(), *map(parts.new.__getitem__, own[1:])]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, ends = _gathered(np.fromiter(chain.from_iterable(ids), np.int32), np.concatenate([[0], np.cumsum(sizes)]), code)
            word_ends = ends[np.flatnonzero(code == 0)[2:]]
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.first = np.concatenate([self.first, self.first[-1] + word_ends])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of what they decode to) of each text, none of which is null.

        Words are divided at ASCII blanks and each distinct one is looked up once; ids are
        written and decoded from the ids of the texts, end to end.
        """
        if len(self.number) > 2 * CACHE_WORDS:
            self.forget()
        words = pc.ascii_split_whitespace(texts)
        first, coded = words.offsets.to_numpy().astype(np.int64), words.flatten().dictionary_encode()
        first -= first[0]
        with _uncollected():
            word = self._number(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        counts = np.zeros(len(texts), np.int64)
        sums = [(hashlib.sha256(), hashlib.sha256()) for _ in range(len(texts))]
        for lo in range(0, len(word), PIECE):
            hi = min(lo + PIECE, len(word))
            ids, ends = _gathered(self.flat, self.first, word[lo:hi])
            a, b = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi))
            cut = ends[np.clip(first[a : b + 1], lo, hi) - lo]
            for k, shown in enumerate((self.blank_decimals, self.blank_names)):
                _, offsets, data = shown.take(pa.array(ids)).buffers()
                at, raw = np.frombuffer(offsets, np.int64)[cut].tolist(), memoryview(data or b"")
                for i, x, y in zip(range(a, b), at, at[1:]):
                    if x < y:  # no blank before a text's first id
                        sums[i][k].update(raw[x + (not counts[i]) : y])
            counts[a:b] += np.diff(cut)
        out = [(n, x.hexdigest(), y.hexdigest()) for n, (x, y) in zip(counts.tolist(), sums, strict=True)]
        if self.any_special:
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, self.any_special)).to_pylist():
                ids = next(self.encode([texts[i].as_py()]))
                out[i] = len(ids), hashlib.sha256(self.shown(ids).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        bpe = self.bpe
        # odd parts are special tokens
        split = [[p if i % 2 else blank_words(p) for i, p in enumerate(bpe.specials.split(t) if bpe.specials and any(x in t for x in bpe.special) else [t])] for t in texts]
        known = self.ids_of({w for parts in split for words in parts[::2] for w in words}).__getitem__
        for parts in split:
            ids: list[int] = []
            for i, p in enumerate(parts):
                if i % 2:
                    ids.append(bpe.special[p])
                else:
                    ids.extend(chain.from_iterable(map(known, p)))
            yield ids

    def shown(self, ids: list[int]) -> str:
        """Decimal ids joined by blanks."""
        return " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a file without a decoder asks."""
        return " ".join(map(self.names.__getitem__, ids))


def _gathered(flat: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[first[n] : first[n + 1]]`` of the numbers end to end, and where each starts (one more at the end)."""
    size = first[numbers + 1] - first[numbers]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(first[numbers] - ends[:-1], size)], ends


class Recent:
    """A bounded cache: what was not asked for while ``size`` others came is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are not known; the known ones are in ``new`` from here on."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    new[k] = v
        return out


def blank_words(text: str) -> list[str]:
    """The text divided at white space; str.split also divides at four control characters, which are none here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def packed(spec: str) -> bytes:
    """An encoder made once by the driver: its tables take ten times as long to make as to read."""
    with _uncollected():
        return pickle.dumps(Encoder(spec))


def encoder(made: bytes) -> Encoder:
    """The encoder of a worker process."""
    key = hashlib.sha256(made).hexdigest()
    if key not in _loaded:
        with _uncollected():
            _loaded[key] = pickle.loads(made)
    return _loaded[key]


def unload() -> None:
    """The worker process keeps no encoder.  Tasks call this by its name: what Spark sends of a nested function has copies of this module's variables."""
    _loaded.clear()


def _batches(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` characters."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > lo:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield batch.slice(lo)


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(df: DataFrame, spec: str, text: str, schema: str, rows_of, most: int = 1 << 20) -> DataFrame:
    """Columns but ``text`` kept; ``rows_of`` makes the added values of the encoder and an array of texts."""
    sent = df.sparkSession.sparkContext.broadcast(packed(spec))  # tables of one tokenizer file, a few MB whatever the data
    fields_of = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields_of], [to_arrow_type(f.dataType) for f in fields_of]
    keep = _free_names(df, names, text)

    def run(batches):
        own = encoder(sent.value)
        for whole in batches:
            for batch in _batches(whole, text, most):
                rows = rows_of(own, pc.fill_null(batch.column(text), ""))
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, keep + names)
        del own
        unload()

    kept = df.select(*keep, text)
    fields = [f"`{n}` {t}" for n, t in kept.drop(text).dtypes]
    return kept.mapInArrow(releasing(run), ", ".join([*fields, schema]))


def _free_names(df: DataFrame, added: list[str], taken: str) -> list[str]:
    """The columns of ``df`` but ``taken``; one named like an added column is refused, not replaced."""
    clash = [c for c in df.columns if c in added and c != taken]
    if clash:
        raise ValueError(f"columns named like results: {', '.join(clash)}")
    return [c for c in df.columns if c != taken]


def encode(df: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """n_tokens, ids (array of int) and decoded_sha256 in place of the text; a null text has an empty array."""

    def rows(own, texts):
        return [(len(ids), np.array(ids, np.int32), hashlib.sha256(own.decode(ids).encode()).hexdigest()) for ids in own.encode(texts.to_pylist())]

    return _encoded(df, spec, text, "n_tokens long, ids array<int>, decoded_sha256 string", rows, 1 << 18)


def decode(df: DataFrame, spec: str, ids: str = "ids") -> DataFrame:
    """``decoded`` in place of the ids: tokens joined by blanks; null ids decode to the empty string."""
    sent = df.sparkSession.sparkContext.broadcast(packed(spec))
    keep = _free_names(df, ["decoded"], ids)

    def run(batches):
        own = encoder(sent.value)
        for b in batches:
            texts = [own.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "decoded"])
        del own
        unload()

    kept = df.select(*keep, ids)
    return kept.mapInArrow(releasing(run), ", ".join([*[f"`{n}` {t}" for n, t in kept.drop(ids).dtypes], "decoded string"]))


def digests(df: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of the text: ids and what they decode to are hashed in the task."""

    return _encoded(df, spec, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", Encoder.digests, 1 << 22)


def default_spec() -> str:
    import public_tokenizers

    return tokenizer_spec(public_tokenizers.path("word_bpe_49k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    docs = empty_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digests(docs, default_spec())


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
