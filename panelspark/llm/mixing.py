"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Each source's share of the mix is fixed by weights and capped by how often its
documents may repeat (``source_targets``).  Within that share its weight changes
over training time: source s has the density ``target_s * (1 + slope_s * (2t - 1))``
for t in [0, 1].  Its integral is the demand for words of s up to time t,

    D_s(t) = target_s * (t + slope_s * (t*t - t)),

and a document whose words end up at y * target_s in its source's order is wanted
at the t where D_s(t) = y * target_s, which is the positive root of a quadratic.
Documents are laid out in hash order within their source; their running word sums
come in two steps (4,096 hash buckets a source, then rows within a bucket), so a
source that holds a third of all rows is still spread over many tasks.

Nulls: a null source is a source of its own, last in order; null text has size 0.
Documents without words are never taken.  Rows that repeat are documents of their
own.  An empty table gives an empty plan.  Columns of the input are kept; those
named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import table, written

WORD = r"[^\x20\x09-\x0D]+"
PATTERN = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
MOST_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of runs of non-blank characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, pattern: tuple = PATTERN, slopes: tuple = SLOPES, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row a source: place, weight, slope, source_size, target.

    Sources by code point, null last, weigh ``pattern`` in turn.  Targets share the sum
    of all sizes by weight and stop at ``repeats`` times the source's size; the excess is
    reshared.  That fixed point is found without a loop: in the order of cap over weight,
    the capped sources are a prefix, so running sums of caps and weights give the level.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    spread = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    spread = spread.withColumns({"weight": _cycle(pattern, F.col("place")).cast("long"), "slope": _cycle(slopes, F.col("place")).cast("double"), "_cap": F.col("source_size") * repeats})
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("place"))
    upto, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    spread = spread.withColumn("_level", F.try_divide(F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(upto), F.lit(0)), F.sum("weight").over(rest)))
    spread = spread.withColumn("_open", F.col("_cap") > F.col("weight") * F.col("_level"))
    # the first open source's level is the water line; rows before it are full
    spread = spread.withColumn("_line", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), "place", "_level"))).over(every)["_level"])
    full = F.col("_line").isNull() | (F.col("_cap") <= F.col("weight") * F.col("_line"))
    spread = spread.withColumn("target", F.when(full, F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_line")))
    return spread.select("source", "place", "weight", "slope", "source_size", "target")


def mix_plan(sized: DataFrame, targets: DataFrame, repeats: int = MOST_REPEATS, tie: Column | None = None) -> DataFrame:
    """``sized`` (doc_id, source, size and any others) with source_size, target, copies, taken, positions.

    ``positions`` holds the training time of each copy.  Every document is taken
    floor(target / source_size) times, and those in the first part of the hash order once
    more, until the source's target is met to within half a document.
    """
    own = ["source_size", "target", "slope", "copies", "taken", "positions"]
    keep = [c for c in sized.columns if c not in own]
    no_id = F.lit("null") if tie is None else F.concat(F.lit("null"), tie.cast("string"))  # rows without an id spread by the tie
    rows = sized.select(*keep).withColumn("_okey", F.md5(F.coalesce(F.col("doc_id").cast("string"), no_id)))
    rows = rows.withColumn("_bucket", F.substring("_okey", 1, 3))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    buckets = buckets.withColumn("_base", F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_n"))
    # one row a source and bucket, joined to a row a source: both follow the number of sources
    buckets = buckets.join(targets.select(F.col("source").alias("_s"), "source_size", "target", "slope"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_n")
    buckets = buckets.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    order = Window.partitionBy("source", "_bucket").orderBy("_okey", F.col("doc_id"), "size", *([tie] if tie is not None else []))
    rows = rows.withColumn("_run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rows = rows.withColumn("_at", F.col("_base") + F.col("_run") + F.col("size") / 2)
    whole = F.least(F.lit(repeats), F.floor(F.try_divide(F.col("target"), F.col("source_size")))).cast("long")
    rows = rows.withColumn("_whole", F.coalesce(whole, F.lit(0)))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("_whole") + ((F.col("_whole") < repeats) & (F.col("_at") <= F.col("target") - F.col("_whole") * F.col("source_size"))).cast("long")).cast("long"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))

    def time(epoch: Column) -> Column:
        y = F.least(F.lit(1.0), F.try_divide(epoch * F.col("source_size") + F.col("_at"), F.col("target")))
        s = F.col("slope")
        return 2 * y / ((1 - s) + F.sqrt((1 - s) * (1 - s) + 4 * s * y))

    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("positions", F.transform(epochs, time))
    return rows.select(*keep, *own)


def mix(docs: DataFrame, pattern: tuple = PATTERN, slopes: tuple = SLOPES, repeats: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: the documents, repeated as planned, range-sorted by training position (columns of ``docs``)."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    targets = written(source_targets(docs.select("source", n_words(F.col("text")).alias("size")), pattern, slopes, repeats), "targets")
    plan = mix_plan(packed, targets, repeats, F.xxhash64("_doc.text"))
    out = plan.select("_doc", "doc_id", F.explode("positions").alias("_time"))
    return out.repartitionByRange("_time", "doc_id").sortWithinPartitions("_time", "doc_id").select("_doc.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    plan = mix_plan(sized, source_targets(sized))
    first = F.round(F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1), 6)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s1),
s3 AS (SELECT *, 1 + place % 3 AS weight, (place % 3 - 1) * 0.5::DOUBLE AS slope, 3 * source_size AS cap FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM s3),
line AS (SELECT min(struct_pack(r := cap / weight, p := place, l := lev)).l AS l FROM s4 WHERE cap > weight * lev),
t AS (SELECT source, source_size, slope,
    CASE WHEN l IS NULL OR cap <= weight * l THEN cap::DOUBLE ELSE weight * l END AS target FROM s4, line),
d AS (SELECT s.*, t.source_size, t.target, t.slope,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size + size / 2 AS mid
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, coalesce(least(3, floor(target / nullif(source_size, 0))), 0)::BIGINT AS whole FROM d),
f AS (SELECT *, CASE WHEN size = 0 THEN 0
    ELSE whole + (whole < 3 AND mid <= target - whole * source_size)::BIGINT END AS copies FROM e)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
  CASE WHEN copies > 0 THEN round(2 * least(1.0, mid / target)
    / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(1.0, mid / target))), 6) END AS first_position
FROM f
"""

QUERIES = {"op4_mixing": op4_mixing}
SQL = {"op4_mixing": OP4_SQL}
