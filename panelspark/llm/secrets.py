"""Secret scans with an incremental blob ledger.

A version of a file is a path (any key columns) and its content.  Content is addressed
by its SHA-256, so a blob that many paths or versions share is one blob.  The ledger is
a Parquet table in a shared folder with a row for each scan of a blob: the rule versions
tried and the spans found.  A run scans only blobs that have a rule version not tried
yet, with those rules alone, appends to the ledger, and joins the findings of the
current rule versions back to every path.

Within a task each blob is passed on once before the shuffle, so that a blob that a
third of all paths share does not gather in one task.

Null content is empty content.  Empty and very long contents are scanned whole.  Rows
that repeat are paths of their own and are all reported.  Extra columns are kept; those
named ``blob`` or ``spans`` are replaced, and ``names`` gives the results other names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import empty_texts, releasing, shared_folder, table, written

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text: str) -> list[tuple[str, int, int]]:
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        return [(self.kind, *m.span()) for m in re.finditer(self.pattern, text, flags) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
ADDED = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 1),
)


def blob_id(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _contents(paths: DataFrame, content: str) -> DataFrame:
    """(blob, content), each blob once a task."""

    def first(batches):
        met: set[bytes] = set()
        for b in batches:
            col = b.column(0)
            ids = [hashlib.sha256(t.as_buffer()).digest() for t in col]
            take = [i for i, x in enumerate(ids) if not (x in met or met.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in take], pa.binary()), col.take(pa.array(take, pa.int64()))], ["blob", "content"])

    return paths.select(F.col(content).alias("content")).mapInArrow(releasing(first), "blob binary, content string")


def _scanned(contents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) for each blob of (blob, content, todo)."""
    by_name = {r.name: r for r in rules}

    def scan(batches):
        met: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for blob, text, todo in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if blob not in met:
                    met.add(blob)
                    t = text.as_py()
                    out.append((blob, todo, [dict(kind=k, start=s, end=e) for n in todo for k, s, e in by_name[n].find(t)]))
            types = (pa.binary(), pa.list_(pa.string()), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["blob", "rules", "spans"])

    return contents.repartition("blob").mapInArrow(releasing(scan), f"blob binary, rules array<string>, spans {SPANS}")


def ledger_of(spark: SparkSession, ledger: str) -> DataFrame | None:
    """(blob, rules, spans) of earlier runs; None where there is no ledger yet."""
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unseen(paths: DataFrame, seen: DataFrame, content: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo): the blobs of ``paths`` with the rule versions that the ledger lacks for them; contents are hashed, not moved."""
    current = F.array(*[F.lit(r.name) for r in rules])
    blobs = paths.select(blob_id(F.coalesce(F.col(content), F.lit(""))).alias("blob")).distinct()
    # a blob has a row a run that scanned it with new rules
    tried = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    todo = F.array_except(current, F.coalesce("_seen", F.array().cast("array<string>")))
    return blobs.join(tried, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan(paths: DataFrame, ledger: str, content: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Brings the ledger (a folder; made on the first run) up to date; returns (blob, spans) for the blobs with findings of the current rules."""
    spark = paths.sparkSession
    seen = ledger_of(spark, ledger)
    contents = _contents(empty_texts(paths, content), content)
    if seen is None:
        _scanned(contents.withColumn("todo", F.array(*[F.lit(r.name) for r in rules])), rules).write.parquet(ledger)
    else:
        todo = written(unseen(paths, seen, content, rules), "todo")
        if not todo.isEmpty():
            _scanned(contents.join(todo, "blob"), rules).write.mode("append").parquet(ledger)
    # a row a scan with findings; a blob has as many as it was scanned with new rules
    found = spark.read.parquet(ledger).where(F.size("spans") > 0).select("blob", F.explode(F.arrays_zip("spans")).alias("_s"), "rules")
    kinds = {r.kind: r.name for r in rules}
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    # an older version's findings do not count
    found = found.where(F.array_contains("rules", named[F.col("_s.spans.kind")]))
    return found.groupBy("blob").agg(F.collect_set("_s.spans").alias("spans"))


def with_findings(paths: DataFrame, found: DataFrame, content: str = "text", names: tuple[str, str] = ("blob", "spans")) -> DataFrame:
    """Every path with its blob and spans (empty where there are none) under ``names``, spans by start, then by kind as the rules list them."""
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(BASE + ADDED) for x in (r.kind, i)])
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.coalesce(kinds[s["kind"]], F.lit(99)).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    blob, out = names
    rows = paths.drop(*names).withColumn(blob, blob_id(F.coalesce(F.col(content), F.lit(""))))
    more = [c for c in found.columns if c not in ("blob", "spans")]
    found = found.select(F.col("blob").alias(blob), spans.alias(out), *more)
    return rows.join(found, blob, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(SPANS))).select(*[c for c in paths.columns if c not in names], *names, *more)


def masked(rows: DataFrame, spans: str = "spans", content: str = "text") -> DataFrame:
    """``rows`` with every span of the content (by start) replaced by its kind in brackets; of overlapping spans the first wins.

    One pass over a text, however many spans; null text stays null, a text without spans as it is.
    """
    names = rows.columns
    at, by = names.index(content), names.index(spans)

    def mask(text: str, found: list[dict]) -> str:
        parts, end = [], 0
        for s in found:
            if s["start"] >= end:
                parts += [text[end : s["start"]], "[", s["kind"], "]"]
                end = s["end"]
        return "".join([*parts, text[end:]])

    def run(batches):
        for b in batches:
            text = b.column(at)
            hit = np.flatnonzero(pc.fill_null(pc.list_value_length(b.column(by)), 0).to_numpy(zero_copy_only=False))
            if len(hit):
                take = pa.array(hit)
                new = [None if t is None else mask(t, f) for t, f in zip(text.take(take).to_pylist(), b.column(by).take(take).to_pylist(), strict=True)]
                flags = np.zeros(len(text), bool)
                flags[hit] = True
                text = pc.replace_with_mask(text, pa.array(flags), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns)], names)

    return rows.mapInArrow(releasing(run), rows.schema)


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: a first run fills the ledger, a second one finds nothing unseen and reports from it.

    ``n_scans`` is how often the text was scanned: once, whatever the number of runs and of its copies.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = new_ledger(spark)
    scan(docs, ledger)
    found = scan(docs, ledger)
    times = spark.read.parquet(ledger).groupBy("blob").agg(F.count("*").alias("n_scans"))
    rows = with_findings(docs, times.join(found, "blob", "left")).select("doc_id", "spans", "n_scans")
    base = [r.kind for r in BASE]

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    only = of(*base)
    return rows.select("doc_id", *counts, F.sha2(_joined(only), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_scans")


QUERIES = {"op5_secrets": op5_secrets}
SQL: dict[str, str] = {}
