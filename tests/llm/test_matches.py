"""Exact deduplication, tokenizer alignment and vector codes against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import align, codes, exact
from tests.llm.test_corpus import LOW, SCHEMA, corpus, table_dir
from tests.oracle import same

AWKWARD = [(None, "no id", None, None, None), (None, "No Id", None, None, None), (None, None, None, None, None), (7, "no id", "en", "a", 1), (7, "no id", "en", "a", 1), (900, "ABC", "en", "a", 1), (901, "abc", "en", "a", 1), (902, "ÀBC", "en", "a", 1), (903, "àbc", "en", "a", 1)]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOW)].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def exact_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_duplicates(spark, monkeypatch):
    rows = corpus() + AWKWARD + [(2000 + i, "long text " * 150_000, "en", "a", 1) for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "n": F.lit("x"), "bucket": F.lit(2), "keep_id": F.lit(3), "at": F.lit(0)})
    assert exact_rows(exact.exact_duplicates(docs)) == exact_by_hand(rows)
    monkeypatch.setattr(exact, "SLOTS", 8)  # many buckets
    monkeypatch.setattr(exact, "FLUSH", 10)
    assert exact_rows(exact.exact_duplicates(docs.repartition(7))) == exact_by_hand(rows)
    assert exact_rows(exact.exact_duplicates(docs.limit(0))) == Counter()
    only = spark.createDataFrame([(None, "a", None, None, None), (None, "A", None, None, None), (None, None, None, None, None)], SCHEMA)
    assert exact_rows(exact.exact_duplicates(only)) == exact_by_hand([tuple(r) for r in only.collect()])


def test_exact_query(spark, tmp_path):
    same(spark, exact.op11_exact, exact.OP11_SQL)
    d = table_dir(spark, tmp_path)
    assert exact_rows(exact.op11_exact(spark, d)) == exact_by_hand(corpus())


def test_deliveries_update_the_index(spark):
    rows = [(i, f"Text {i % 40}") for i in range(300)]
    parts = [spark.createDataFrame(rows[a:b], "doc_id long, text string") for a, b in ((0, 30), (30, 31), (31, 300))]
    entries = None
    for k, p in enumerate(parts):
        entries = exact.absorb(None if entries is None else exact.build_index(entries.drop("repeats")), exact.digests(p.select(F.col("doc_id") + 0, "text").toDF("doc_id", "text")))
        assert entries.agg(F.sum("n")).first()[0] == (30, 31, 300)[k]
    got = {(r["doc"], r["n"]) for r in entries.collect()}
    assert got == {(max(i for i in range(300) if i % 40 == k), sum(i % 40 == k for i in range(300))) for k in range(40)}
    assert entries.agg(F.sum("repeats")).first()[0] == sum(i % 40 < 31 for i in range(31, 300))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    h = exact.PerfectHash.of(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))
    other = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    at = h.slots(other)
    assert ((at >= -1) & (at < max(n, 1))).all()
    assert not any((keys[s] == o).all() for s, o in zip(at, other, strict=True) if s >= 0)
    if n > 1:
        with pytest.raises(ValueError, match="distinct"):
            exact.PerfectHash.of(np.concatenate([keys, keys[:1]]))


def aligned_by_hand(rows):
    """Whole texts in both libraries, group ends as common ends, links by overlapping ranges."""
    p = align.Pair(*align.default_files())
    out, links = [], []
    for i, t in rows:
        t = t or ""
        a, b = p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t)
        whole = b"".join(p.a_bytes[x] for x in a)
        if not t or whole != (" " + t).encode() or whole != b"".join(p.b_bytes[x] for x in b):
            out.append((i, 0, 0, 0, 0, ""))
            links.append(Counter())
            continue
        ea, eb = (np.cumsum([len(n[x]) for x in ids]).tolist() for n, ids in ((p.a_bytes, a), (p.b_bytes, b)))
        groups, x, y = [], 0, 0
        for end in sorted({*ea} & {*eb}):
            u, v = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        here = Counter()
        for u, (s, e) in enumerate(zip([0, *ea], ea)):
            for v, (s2, e2) in enumerate(zip([0, *eb], eb)):
                if s < e2 and s2 < e:
                    here[a[u], b[v]] += 1
        links.append(here)
        out.append((i, len(a), len(b), len(groups), sum(here.values()), ";".join(groups)))
    docs = Counter(k for here in links for k in here)
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    best = [sum(c for k, c in here.items() if docs[k] == most[k[0]]) for here in links]
    return Counter((*o[:5], x, sum(c * docs[k] for k, c in here.items()), o[5]) for o, x, here in zip(out, best, links, strict=True))


def aligned_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())


ODD = [" ", "  ", "a ", "a  b", "  a\n b", "a\n  b \n", "tab\t x", "\x1c a\x1d b", "one▁two", "▁", "<s> </s> <unk> <0x41>", "<|endoftext|> and more", "é à 中文字 日本語 ไทย", "  nb  x", "0123456789abcdef" * 20, "é 🙂🙂 x", "'s it's 'S", "\x00a\x00 b", "　 wide"]


def test_alignment(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, t) for i, (_, t, *_) in enumerate(corpus(25))]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, rows[3][1]), (200, "the " * 30)]
    rows += [(300 + i, "".join(rnd.choice(" a\n\tb'éx. 1▂") for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit(1), "pairs": F.lit("x"), "id": F.lit(2), "groups": F.lit(3)})
    want = aligned_by_hand(rows)
    a, b = align.default_files()
    assert aligned_rows(align.cross_tokenizer(docs, a, b)) == want
    digest = {r["doc_id"]: r["groups"] for r in align.cross_tokenizer(docs, a, b, digest=True).collect()}
    assert digest[200] == hashlib.sha256(next(r[7] for r in want if r[0] == 200).encode()).hexdigest() and digest[100 + ODD.index("▁")] == ""
    # many chunks, long texts in runs, words forgotten
    for name, value in (("CHUNK", 200), ("RUN", 40), ("WORDS", 50)):
        monkeypatch.setattr(align, name, value)
    assert aligned_rows(align.cross_tokenizer(docs.repartition(3), a, b)) == want
    assert align.cross_tokenizer(docs.limit(0), a, b).count() == 0


def test_alignment_of_long_texts(spark):
    text = " ".join(f"w{i % 977} said-{i}" for i in range(120_000))  # over one run
    pair = align.Pair(*align.default_files())
    counts, groups, pairs = align._Aligner(pair, digest=False).align([text, "x"])
    whole = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    assert len(text) > 1.5 * align.RUN and counts[0][:2] == (len(whole[0]), len(whole[1]))
    assert [",".join(g.split("|")[k] for g in groups[0].split(";")) for k in (0, 1)] == [",".join(map(str, ids)) for ids in whole]
    assert pairs[0][1].sum() == counts[0][3] == sum(counts[0][:2]) - counts[0][2]


def test_merge_path_pieces():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 60)
        a, b = (np.array(sorted({n, *(rnd.randint(1, n) for _ in range(rnd.randint(0, 40)))})) for _ in range(2))
        starts = [[0, *x[:-1].tolist()] for x in (a, b)]
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        ends = [(int(np.searchsorted(a, e)) + 1, int(np.searchsorted(b, e)) + 1) for e in sorted({*a.tolist()} & {*b.tolist()})]
        for piece in (1, 2, 7, 256):
            i, j, ei, ej = align.merge_path(a, b, piece)
            assert list(zip(i.tolist(), j.tolist(), strict=True)) == links and list(zip(ei.tolist(), ej.tolist(), strict=True)) == ends


def coded_by_hand(rows, rounds=6, entries=16, parts=8):
    """Plain integers, every distance in every round."""
    kept = [(i, lab, [int(np.floor(4096 * float(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for n in {len(v) for *_, v in kept}:
        w = -(-n // parts)
        some = [(i, lab, v + [0] * (parts * w - n)) for i, lab, v in kept if len(v) == n]
        first = sorted(some, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
        books = [[r[2][p * w : p * w + w] for r in first] for p in range(parts)]

        def near(v, p):
            d = [sum((x - y) ** 2 for x, y in zip(v[p * w : p * w + w], c)) for c in books[p]]
            return d.index(min(d)), min(d)

        for _ in range(rounds):
            code = [[near(v, p)[0] for p in range(parts)] for *_, v in some]
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [v[p * w : p * w + w] for (*_, v), c in zip(some, code) if c[p] == e]
                    if mine:
                        books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for k, (i, lab, v) in enumerate(some):
            got = [near(v, p) for p in range(parts)]
            out[n, k] = (i, lab, "".join("%02x" % c for c, _ in got), sum(d for _, d in got), sha)
    total = Counter()
    for i, lab, _, e, _ in out.values():
        total[lab] += e
    return Counter((i, c, e, total[lab], sha) for i, lab, c, e, sha in out.values())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"q": F.lit(1), "code": F.lit("x"), "part": F.lit(2), "n": F.lit(3), "id": F.lit(9)})


def test_codes(spark):
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=(20, 24))
    rows = [(int(i), (centre[i % 20] + rnd.normal(scale=0.1, size=24)).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rnd.permutation(260)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], 2), (1000, None, 1), (1001, [1.0, None, 2.0], 1), (1002, [float("nan")] * 24, 1), (1003, [float("inf")] * 24, 1)]
    rows += [(2000 + i, [0.5] * 24, 4) for i in range(40)] + [(3000 + i, [float(i % 5), 1.0, -2.5], 5) for i in range(20)] + [(4000, [], 5), (4001, [7.0], 6), (4002, [7.0], None)]
    got = Counter(tuple(r) for r in codes.compressed(vectors(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == coded_by_hand(rows)
    big = [(i, (rnd.normal(size=16) * 3000).tolist(), 1) for i in range(60)]  # products beyond 2**53
    got = Counter(tuple(r) for r in codes.compressed(vectors(spark, big)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == coded_by_hand(big)
    assert codes.compressed(vectors(spark, rows[:0])).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compressed(vectors(spark, [(1, [1e30] * 16, 1)])).count()


def test_codes_query_and_bounds(spark):
    same(spark, codes.op13_codes, codes.SQL["op13_codes"])
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = v.count() * codes.PARTS
    scans = codes.learn(codes.quantised(v, "vec_id", "embedding", "label"))[2]
    assert scans[0] == n and scans[-1] < 0.8 * n  # bounds spare rescans


def test_bounds_use_net_moves():
    there, back = np.zeros((codes.PARTS, 2, 1)), np.zeros((codes.PARTS, 2, 1))
    there[:, 1], back[:, 1] = 100, 0
    b = codes.Bounds([back, there, back], wide=False)
    assert (b.others[0] == 0).all() and (b.others[1].max() > 99)  # out and home again: nothing is lost
