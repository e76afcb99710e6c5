"""Writers: files by extension, snapshots with digests, fold panels, exports and an append-only trial log."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Tasks that one fold and split are written by.
SPREAD = 8

_MANIFEST = "snapshot_id string, table string, sources string, provenance string, created_at timestamp, n long, digest string, first_date date, last_date date"


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV by extension."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end not in ("parquet", "csv"):
        raise ValueError(f"no writer for .{end}")
    df.write.mode(mode).parquet(path) if end == "parquet" else df.write.mode(mode).option("header", True).csv(path)


def digest(df: DataFrame) -> DataFrame:
    """One row (n, digest) that depends on the schema and the multiset of rows, not on their order."""
    cols = sorted(df.columns)
    names = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols)
    # each value with a mark for null, so that nulls in different columns differ
    parts = [p for c in cols for p in (F.col(c).isNull(), F.col(c))]
    rows = df.select(F.xxhash64(*parts).alias("h"))
    got = rows.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return got.select("n", F.sha2(F.concat_ws("|", F.lit(names), "n", F.coalesce(F.col("s").cast("string"), F.lit("")), F.coalesce(F.col("x").cast("string"), F.lit(""))), 256).alias("digest"))


def date_range(df: DataFrame) -> DataFrame:
    """One row with first and last value of the first date column (null without one)."""
    day = next((c for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")), None)
    c = F.col(day).cast("date") if day else F.lit(None).cast("date")
    return df.agg(F.min(c).alias("first_date"), F.max(c).alias("last_date"))


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark keeps it."""
    fs, at = _filesystem(spark, path)
    fs.delete(at, True)


def ordered_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest) of a Parquet table that depends on the order of its rows too, by file and by place in it.

    Each row's hash takes in its number; the number of a file's first row comes from the counts of the files before.
    """
    cols = sorted(df.columns)
    parts = [p for c in cols for p in (F.col(c).isNull(), F.col(c))]
    rows = df.select(F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_i"), *[p.alias(f"_v{i}") for i, p in enumerate(parts)])
    files = rows.groupBy("_f").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))  # a row a file
    names = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols)
    h = F.xxhash64(F.col("_b") + F.col("_i"), *[f"_v{i}" for i in range(len(parts))])
    got = rows.join(F.broadcast(files), "_f").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return got.select("n", F.sha2(F.concat_ws("|", F.lit(names), F.lit("ordered"), "n", F.coalesce(F.col("s").cast("string"), F.lit(""))), 256).alias("digest"))


def gated_snapshot(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], critical: Mapping[str, Mapping[str, Column]], sources: str, provenance: str) -> tuple[str, dict[str, dict[str, int]]]:
    """Writes each table in the order of its keys and a manifest row for each, if no critical rule is broken; the id and the counts of all rules.

    A table is range-partitioned and sorted by its keys, so its files lie in one canonical order,
    of which the digest is taken.  ``critical`` names conditions that no row may meet: they are
    counted in the pass that writes.  Rows that repeat a key are critical too, and are found
    among the written rows.  With any finding the written files are removed, no
    manifest row is written, and ValueError tells the counts.  The id is the digest of all
    digests, so the same content is the same snapshot, which is written once.
    """
    at = uuid.uuid4().hex
    held: dict[str, DataFrame] = {}
    found: dict[str, dict[str, int]] = {}
    staged = f"{root}/staged/{at}"
    try:
        for name, df in sorted(tables.items()):
            order = list(keys[name])
            seen = Observation(f"{name}-{at}")
            rules = critical.get(name, {})
            counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())]
            nulls = F.count_if(F.array_contains(F.array(*[F.col(k).isNull() for k in order]), True)).alias("null_key")
            rest = [c for c in df.columns if c not in order]
            # counted behind the exchange: the range partitioning reads what is before it twice
            lined = df.repartitionByRange(*order).sortWithinPartitions(*order, *rest).observe(seen, nulls, *counts)
            lined.write.parquet(f"{staged}/{name}")
            held[name] = spark.read.schema(df.schema).parquet(f"{staged}/{name}")
            got = seen.get
            found[name] = {"null_key": got["null_key"]} | {rule: got[f"r{i}"] for i, rule in enumerate(rules)}
            again = held[name].groupBy(*order).agg(F.count("*").alias("_n")).where("_n > 1")
            found[name]["repeated_key"] = again.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]
        bad = {f"{t}.{r}": n for t, rules in found.items() for r, n in rules.items() if n}
        if bad:
            raise ValueError(f"critical findings: {bad}")
        rows = None
        for name, df in held.items():
            row = ordered_digest(df).crossJoin(date_range(df)).select(F.lit(name).alias("table"), "n", "digest", "first_date", "last_date")
            rows = row if rows is None else rows.unionByName(row)
        lines = sorted(rows.collect(), key=lambda r: r["table"])  # a row a table
        identity = "|".join([sources, provenance, *(f"{r['table']}:{r['digest']}" for r in lines)])
        sid = hashlib.sha256(identity.encode()).hexdigest()[:24]
        fs, target = _filesystem(spark, f"{root}/data/snapshot={sid}")
        if fs.exists(target):
            return sid, found
        fs.mkdirs(target.getParent())
        if not fs.rename(_filesystem(spark, staged)[1], target):
            raise OSError(f"the snapshot could not be moved to {target}")
        kept = spark.createDataFrame([(sid, r["table"], sources, provenance, r["n"], r["digest"], r["first_date"], r["last_date"]) for r in lines], "snapshot_id string, table string, sources string, provenance string, n long, digest string, first_date date, last_date date")
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        kept.withColumn("created_at", F.current_timestamp()).select(*names).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
        return sid, found
    finally:
        removed(spark, staged)


def in_order(spark: SparkSession, root: str, snapshot_id: str, table: str) -> bool:
    """Whether a table of a gated snapshot still has the digest of its manifest row, order included."""
    was = manifest(spark, root).where((F.col("snapshot_id") == snapshot_id) & (F.col("table") == table)).select("digest").first()
    if was is None:
        raise ValueError(f"no table {table} in snapshot {snapshot_id}")
    return ordered_digest(spark.read.parquet(f"{root}/data/snapshot={snapshot_id}/{table}")).first()["digest"] == was["digest"]


def snapshot(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], sources: str, provenance: str) -> str:
    """Writes each table under a new id and a manifest row for each; returns the id."""
    at = uuid.uuid4().hex
    rows = None
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{root}/data/snapshot={at}/{name}")
        kept = spark.read.parquet(f"{root}/data/snapshot={at}/{name}")
        row = digest(kept).crossJoin(date_range(kept)).select(F.lit(at).alias("snapshot_id"), F.lit(name).alias("table"), F.lit(sources).alias("sources"), F.lit(provenance).alias("provenance"), F.current_timestamp().alias("created_at"), "n", "digest", "first_date", "last_date")
        rows = row if rows is None else rows.unionByName(row)
    rows.write.mode("append").parquet(f"{root}/manifest")
    return at


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def snapshots(spark: SparkSession, root: str, sources: str | None = None, provenance: str | None = None) -> DataFrame:
    """Snapshots, newest first, optionally those of one source set and provenance."""
    df = manifest(spark, root)
    for c, v in (("sources", sources), ("provenance", provenance)):
        df = df if v is None else df.where(F.col(c) == v)
    return df.groupBy("snapshot_id", "sources", "provenance").agg(F.max("created_at").alias("created_at"), F.count("*").alias("n_tables")).orderBy(F.col("created_at").desc(), "snapshot_id")


def verify(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """(table, n, ok): whether each table's digest is still that of the manifest."""
    out = None
    names = [r["table"] for r in manifest(spark, root).where(F.col("snapshot_id") == snapshot_id).select("table").distinct().collect()]
    if not names:
        raise ValueError(f"no snapshot {snapshot_id}")
    for name in names:
        now = digest(spark.read.parquet(f"{root}/data/snapshot={snapshot_id}/{name}")).select(F.lit(name).alias("table"), "n", F.col("digest").alias("now"))
        out = now if out is None else out.unionByName(now)
    was = manifest(spark, root).where(F.col("snapshot_id") == snapshot_id).select("table", "digest")
    return out.join(was, "table").select("table", "n", (F.col("now") == F.col("digest")).alias("ok"))


def fold_panels(panel: DataFrame, path: str) -> DataFrame:
    """A panel with ``fold`` and ``split`` written so that one fold or split is read alone."""
    panel.repartition("fold", "split").write.mode("overwrite").partitionBy("fold", "split").parquet(path)
    return panel.sparkSession.read.parquet(path)


def content_key(inputs: Mapping[str, DataFrame], settings: Mapping[str, object]) -> str:
    """A key of what a panel is made of: the digests of its inputs and its settings, by name."""
    rows = None
    for name, df in sorted(inputs.items()):
        row = digest(df).select(F.lit(name).alias("name"), "n", "digest")
        rows = row if rows is None else rows.unionByName(row)
    held = sorted((r["name"], r["n"], r["digest"]) for r in rows.collect()) if rows is not None else []  # a row an input
    return hashlib.sha256(json.dumps([held, settings], sort_keys=True, default=str).encode()).hexdigest()[:24]


def keyed_panels(spark: SparkSession, root: str, key: str, make: Callable[[], Mapping[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
    """The tables under a key, and whether they were there already; ``make`` is called only if they were not.

    Tables with ``fold`` and ``split`` lie in folders of these, so one fold is read alone.  All are
    written aside and moved in one step, so a key that exists is whole: two writers of one key
    leave the first one's tables.
    """
    fs, target = _filesystem(spark, f"{root}/panel={key}")
    found = fs.exists(target)
    if not found:
        staged = f"{root}/staged/{uuid.uuid4().hex}"
        try:
            for name, df in make().items():
                out = df
                by = [c for c in ("fold", "split") if c in df.columns]
                if by:
                    # a fold's rows go to several tasks, since a split of one fold may be large
                    out = df.repartition(*by, F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(SPREAD)))
                (out.write.partitionBy(*by) if by else out.write).parquet(f"{staged}/{name}")
            fs.mkdirs(target.getParent())
            if not fs.rename(_filesystem(spark, staged)[1], target) and not fs.exists(target):
                raise OSError(f"the panels could not be moved to {target}")
        finally:
            removed(spark, staged)
    names = [f.getPath().getName() for f in fs.listStatus(target)]  # a folder a table
    return {n: spark.read.parquet(f"{root}/panel={key}/{n}") for n in names}, found


def export(df: DataFrame, path: str) -> None:
    """A small result table as one CSV and one JSON file (the caller aggregates first)."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    one.write.mode("overwrite").json(f"{path}/json")


def log_trial(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").json(path)


def trials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The trial log; malformed lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
