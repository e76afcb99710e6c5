"""A training-corpus pipeline out of the operators of panelspark.llm.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns the
columns of ``documents``, further ones included and under whatever names (the last stage
returns tokens).  ``run`` applies them in order and writes each result as Parquet in the
shared folder before the next stage reads it.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.bpe import default_spec, encode
from panelspark.llm.jaccard import jaccard_components
from panelspark.llm.langid import fit, identify
from panelspark.llm.mixing import mix
from panelspark.llm.secrets import masked, new_ledger, scan, with_findings
from panelspark.llm.shared import bounded_batches, table, written

SHINGLE, NUM, DEN = 5, 80, 100


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of ``docs`` has (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return tuple(out)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rows whose text is null or has no letter go; a null language is filled in.

    Such rows are told by their score of 0, which no predicted language has: ``und`` may be a
    language of the labelled rows as well, and its documents stay.

    The model is learned from the stage's own labelled rows, so without a labelled row no
    language is known and all rows go.  Rows are judged one by one: ids, null or repeated, do not matter.
    """
    bounded_batches(spark)
    names = _free(docs, "lang_pred", "score", "spans")
    out = identify(docs, fit(docs), names=names)
    return out.where(F.col(names[1]) > 0).withColumn("lang", F.coalesce("lang", names[0])).select(*docs.columns)


def _own_ids(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a key a distinct (id, text): the id where it names one text, else a number over 2**62 from a hash of both."""
    digest = F.xxhash64("doc_id", "text")
    several = docs.groupBy("doc_id").agg((F.min(digest) != F.max(digest)).alias("_s")).where("_s OR doc_id IS NULL").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    mark = several.select(F.col("doc_id").alias("_several"), F.lit(True).alias("_hashed"))
    rows = docs.join(mark, F.col("doc_id").eqNullSafe(F.col("_several")), "left")
    hashed = F.shiftrightunsigned(digest, 2) + F.lit(1 << 62)
    return written(rows.withColumn(key, F.when(F.col("_hashed"), hashed).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, key), "keyed")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (5 words, 0.8): of each group of linked documents the one with the smallest id stays.

    A document is an id with a text.  Rows that repeat both are one document, of which one
    row stays.  Different texts under one id, or under none, are documents of their own, and
    come after those whose id is theirs alone.  Texts without words link with nothing and stay.
    """
    bounded_batches(spark)
    key, number = _free(docs, "key", "number")
    rows = _own_ids(docs, key)
    groups = jaccard_components(rows.select(key, "text"), SHINGLE, NUM, DEN, key=key)
    stay = groups.where(F.col(key) == F.col("component_id")).select(key).distinct()
    rows = rows.join(stay, key, "left_semi")
    first = Window.partitionBy(key, F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret is replaced by its kind in brackets, and n_chars follows; no row goes.

    Null and empty texts stay as they are; rows that repeat are all masked.
    """
    bounded_batches(spark)
    names = _free(docs, "blob", "spans")
    rows = with_findings(docs, scan(docs, new_ledger(spark)), names=names)
    rows = masked(rows.select(*docs.columns, names[1]), names[1])
    kind = dict(docs.dtypes)["n_chars"]
    chars = F.when(F.size(names[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", chars).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are repeated or left out as the mix plans, in training order.

    Texts without words are never taken; a null source is a source of its own; rows that repeat count each.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: one row a training document (doc_id, lang, source) with n_tokens, ids and decoded_sha256; null text has no tokens."""
    bounded_batches(spark)
    return encode(docs.select("doc_id", "lang", "source", "text"), default_spec())


STAGES = [
    ("language identification", language),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]
#: The language model, the join's sketch and the tokenizer are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
