"""What a worker process keeps of the encoder: nothing between tasks, and no more than its pre-tokens within one."""

import pytest

from panelspark.llm import bpe


@pytest.mark.parametrize("run", [bpe.encode, bpe.digests, lambda df, spec: bpe.decode(bpe.encode(df, spec), spec)])
def test_workers_keep_no_encoder(spark, run):
    docs = spark.createDataFrame([(i, f"the sea {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert run(docs, bpe.default_spec()).count() == 40
    run(docs, bpe.default_spec()).collect()

    def kept(batches):
        import pyarrow as pa

        from panelspark.llm import bpe as own

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [len(own._loaded)]})

    # the idle workers go on with these tasks
    assert {r["n"] for r in spark.range(0, 400, 1, 8).mapInArrow(kept, "n long").collect()} == {0}


def test_words_are_not_remembered_beside_their_parts():
    own = bpe.Encoder(bpe.default_spec())
    texts = [" ".join(f"({a}{b}{c}," for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"), "(aaa, hhh"]
    first = [ids for t in texts for ids in own.encode([t])]
    assert [ids for t in texts for ids in own.encode([t])] == first
    held = [v for v in vars(own).values() if isinstance(v, bpe.Recent)]
    assert sum(len(r.new) + len(r.old) for r in held) == len({*"(,"} | {t for t in texts[0].split()})
