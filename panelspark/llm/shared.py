"""Where intermediate tables live, and the few Spark helpers that every operator needs."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The temporary folder of a local session that names no shared one.
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder, one a driver process; a
    cluster is refused, since a machine-local folder would not be seen by other executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="panelspark-"))
        at = _own_folder[0]
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB at most, whatever the length of texts, unless the session sets its own bounds."""
    for key, usual, ours in (("maxBytesPerBatch", ("67108864", "67108864b", "64MB", "64m"), "4m"), ("maxRecordsPerBatch", ("10000",), "4000")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) in usual:
            spark.conf.set(key, ours)


def free() -> None:
    """Gives the memory of a worker's finished work back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it keeps
        return


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow and mapInPandas; the worker, which goes on to other tasks, holds nothing of it afterwards."""

    def work(batches: Iterator) -> Iterator:
        yield from run(batches)
        free()

    return work


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a frame that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """Null text read as empty."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


#: A key that holds over 1 / HEAVY of all rows is heavy: there are fewer than HEAVY of them.
HEAVY = 1024


def joined_by_heavy_key(rows: DataFrame, totals: DataFrame, key: str, count: str, of: int) -> DataFrame:
    """``rows`` with the columns of ``totals``, which holds every key of theirs once with its ``count`` of rows, null too.

    Heavy keys (fewer than HEAVY, since counts add up to ``of``) are broadcast, so no task gets
    all rows of one; the other keys are joined by a shuffle.
    """
    heavy = totals.where(F.col(count) * HEAVY > of).withColumnRenamed(key, "_k")
    light = totals.where(F.col(count) * HEAVY <= of).withColumnRenamed(key, "_k")
    same = F.col(key).eqNullSafe(F.col("_k"))
    met = rows.join(F.broadcast(heavy), same).drop("_k")
    rest = rows.join(F.broadcast(heavy.select("_k")), same, "left_anti").join(light, same).drop("_k")
    return met.unionByName(rest)
