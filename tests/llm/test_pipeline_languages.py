"""The pipeline's first stage where a label is the code for undetermined languages."""

import corpus_pipeline as P
from tests.llm.test_corpus import SCHEMA


def test_documents_labelled_und_stay(spark):
    en = "the house and the garden are under the old tree by the river"
    und = "zpqx kwrt vblm qqzt wkpx rrvb mlkz tqwx"
    rows = [(i, f"{en} {i}", "en", "a", 1) for i in range(12)] + [(100 + i, f"{und} {i}", "und", "a", 1) for i in range(12)]
    rows += [(200, None, "en", "a", 0), (201, "12 34 --", "und", "a", 0), (202, und, None, "a", 0), (203, "", None, "a", 0)]
    got = {r["doc_id"]: r["lang"] for r in P.STAGES[0][1](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert set(got) == {*range(12), *range(100, 112), 202}
    assert got[202] == "und" and got[3] == "en"
