"""Registered corpus queries against independent versions on the given documents."""

import hashlib
import re
import zlib

import duckdb
import pytest

from panelspark.llm import langid, registry
from tests.oracle import DIR

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def documents(d):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{d}/documents.parquet'").fetchall()


def test_secrets_of_a_corpus(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.QUERIES["op5_secrets"](spark, d).collect()}
    rows = documents(d)
    assert len(got) == len(rows)
    some = 0
    for i, text, _ in rows:
        spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))))
        r = got[i]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        some += len(spans)
    assert some > 5


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_langid"](spark, d).collect()}
    rows = documents(d)
    held = [(i, lang) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(rows) and {i for i, _ in held} == {i for i, r in got.items() if r["held_out"]}
    known = [(i, lang) for i, lang in held if lang is not None and got[i]["lang_pred"] != langid.UNKNOWN]
    right = sum(got[i]["lang_pred"] == lang for i, lang in known)
    assert len(known) > 100 and right / len(known) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert got[i]["lang_pred"] == langid.UNKNOWN and got[i]["score"] == 0


@pytest.mark.parametrize("name", ["op3_neardup", "op11_exact", "op12_align", "op13_codes"])
def test_results_are_the_same_at_every_run(spark, name):
    a, b = (sorted(map(str, registry.QUERIES[name](spark, DIR).collect())) for _ in range(2))
    assert a == b and a


def test_ledger_meets_unseen_seen_and_half_scanned_blobs(spark, tmp_path):
    from panelspark.llm import secrets

    key, other = "AKIA" + "A1" * 9, "password = hunter22"
    text = {1: f"one {key}", 2: f"two {other}", 3: "three", 4: f"four {key} {other}", 5: None}
    rows = lambda ids: spark.createDataFrame([(i, text[i]) for i in ids], "path long, text string")
    ledger = str(tmp_path / "ledger")
    fewer = secrets.BASE[:1]
    secrets.scan(rows([1, 2]), ledger, rules=fewer)
    # both known blobs lack two rules, two blobs and the empty one are new; one path repeats a known blob
    found = secrets.scan(rows([1, 2, 2, 3, 4, 5]), ledger, rules=secrets.BASE)
    log = spark.read.parquet(ledger).collect()
    by = {}
    for r in log:
        by.setdefault(bytes(r["blob"]), []).append(sorted(r["rules"]))
    one, two, three, four = (hashlib.sha256(text[i].encode()).digest() for i in (1, 2, 3, 4))
    every, rest = sorted(r.name for r in secrets.BASE), sorted(r.name for r in secrets.BASE[1:])
    assert sorted(by[one]) == sorted([[fewer[0].name], rest]) and sorted(by[two]) == sorted([[fewer[0].name], rest])
    assert by[three] == [every] and by[four] == [every] and by[hashlib.sha256(b"").digest()] == [every] and len(by) == 5
    got = {(r["path"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in secrets.with_findings(rows([1, 2, 2, 3, 4, 5]), found).collect()}
    assert got == {(1, (("access", 4, 26),)), (2, (("assign", 4, 23),)), (3, ()), (4, (("access", 5, 27), ("assign", 28, 47))), (5, ())}
    assert secrets.scan(rows([4]), ledger, rules=secrets.BASE).count() == 3 and spark.read.parquet(ledger).count() == len(log)
