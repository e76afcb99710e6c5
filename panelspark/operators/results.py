"""Results tables: typed appends, filtered and paged reads, summaries, lineage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES: Mapping[str, str] = {
    "research_run": "run_id string, state string, at timestamp, charter_hash string, snapshot_id string, models_json string",
    "fold": "run_id string, fold int, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date",
    "prediction": "run_id string, model string, fold int, as_of date, security_id string, score double, rank double",
    "fold_metric": "run_id string, model string, fold int, metric string, value double",
    "artifact": "run_id string, model string, fold int, path string, fold_hash string",
    "strategy_execution": "run_id string, model string, strategy string, cost_scenario string, state string",
    "strategy_result": "run_id string, model string, strategy string, cost_scenario string, metric string, value double",
    "strategy_equity": "run_id string, model string, strategy string, cost_scenario string, as_of date, value double, net_return double",
    "target_weight": "run_id string, model string, strategy string, as_of date, security_id string, weight double",
    "optimizer_diagnostic": "run_id string, model string, strategy string, as_of date, status string, relaxations_json string",
    "trade": "run_id string, model string, strategy string, cost_scenario string, information_date date, signal_date date, order_date date, fill_date date, accounting_date date, security_id string, side string, shares double, reference_price double, effective_price double, notional double, commission double, spread_cost double, slippage_cost double, impact_cost double",
    "overfitting_metric": "run_id string, model string, metric string, value double, details_json string",
    "holdout_evaluation": "run_id string, model string, at timestamp, metrics_json string",
}
MOST_ROWS = 1_000_000


def append(df: DataFrame, root: str, table: str) -> None:
    """Appends rows with the table's columns, each run in its own partition."""
    spec = df.sparkSession.createDataFrame([], TABLES[table]).schema
    if set(df.columns) != set(spec.fieldNames()):
        raise ValueError(f"{table} needs exactly {', '.join(spec.fieldNames())}")
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec])
    out.write.mode("append").partitionBy("run_id").parquet(f"{root}/{table}")


def replace_run(df: DataFrame, root: str, table: str) -> None:
    """Writes a run again: only the partitions of the runs in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str, limit: int | None = None, **equal) -> DataFrame:
    """Rows of a table with column = value filters (run_id prunes partitions); an empty answer is an error."""
    if table not in TABLES:
        raise ValueError(f"no table {table}")
    if limit is not None and not 0 < limit <= MOST_ROWS:
        raise ValueError(f"the limit must be in 1..{MOST_ROWS}")
    df = spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if not df.limit(1).count():
        raise LookupError(f"no rows in {table} for {equal}")
    return df if limit is None else df.limit(limit)


def _reads_only(spark: SparkSession, sql: str) -> list[str]:
    """The tables that one statement reads, from its parsed plan; a statement that is no query, or more than one, is refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError("only one SELECT statement is allowed") from e
    forname = spark._jvm.java.lang.Class.forName
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    acting = [forname(logical + c) for c in ("Command", "ParsedStatement")]
    names: list[str] = []

    def walk(node) -> None:
        if any(c.isInstance(node) for c in acting):
            raise ValueError("only one SELECT statement is allowed")
        if node.getClass().getSimpleName() == "UnresolvedRelation":
            names.append(node.multipartIdentifier().mkString("."))
        for kind in (node.children(), node.innerChildren()):
            for i in range(kind.size()):
                walk(kind.apply(i))

    walk(plan)
    # subqueries stand in expressions, which the text of the plan shows
    names.extend(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan.toString()))
    if forname(logical + "Command").isInstance(plan):
        raise ValueError("only one SELECT statement is allowed")
    return [n.replace(", ", ".") for n in dict.fromkeys(names)]


def select_only(spark: SparkSession, root: str, sql: str, tables: Sequence[str] | None = None) -> DataFrame:
    """One SELECT over the results tables; what it reads and whether it only reads is taken from its parsed plan."""
    text = sql.strip().rstrip(";").strip()
    asked = _reads_only(spark, text)
    for t in tables or [t for t in TABLES if t in asked]:
        spark.read.schema(TABLES[t]).parquet(f"{root}/{t}").createOrReplaceTempView(t)
    return spark.sql(text)


def _purpose(spark: SparkSession, root: str, table: str, run_id: str, model: str | None = None, strategy: str | None = None, scenario: str | None = None) -> DataFrame:
    """Rows of one run; filters that the table has no column for do not apply, and an empty answer is an empty frame."""
    df = spark.read.schema(TABLES[table]).parquet(f"{root}/{table}").where(F.col("run_id") == run_id)
    for c, v in (("model", model), ("strategy", strategy), ("cost_scenario", scenario)):
        if v is not None and c in df.columns:
            df = df.where(F.col(c) == v)
    return df


#: What users ask of a run: the table, the order of its rows, and JSON columns with the types that they are read as.
PURPOSES: Mapping[str, tuple[str, tuple[str, ...], Mapping[str, str]]] = {
    "folds": ("fold", ("fold",), {}),
    "fold_metrics": ("fold_metric", ("model", "fold", "metric"), {}),
    "predictions": ("prediction", ("as_of", "model", "security_id"), {}),
    "strategy_metrics": ("strategy_result", ("model", "strategy", "cost_scenario", "metric"), {}),
    "equity": ("strategy_equity", ("model", "strategy", "cost_scenario", "as_of"), {}),
    "trades": ("trade", ("fill_date", "model", "strategy", "cost_scenario", "security_id"), {}),
    "weights": ("target_weight", ("as_of", "model", "strategy", "security_id"), {}),
    "diagnostics": ("optimizer_diagnostic", ("as_of", "model", "strategy"), {"relaxations_json": "array<string>"}),
    "overfitting": ("overfitting_metric", ("model", "metric"), {"details_json": "map<string,string>"}),
    "holdout": ("holdout_evaluation", ("at", "model"), {"metrics_json": "map<string,double>"}),
}


def ask(spark: SparkSession, root: str, purpose: str, run_id: str, limit: int = 1000, offset: int = 0, start: date | None = None, end: date | None = None, **equal) -> tuple[DataFrame, int]:
    """(one page in the purpose's order, total number of rows); JSON columns come as lists and maps."""
    if purpose not in PURPOSES:
        raise ValueError(f"no purpose {purpose}: {', '.join(PURPOSES)}")
    if not 0 < limit <= MOST_ROWS:
        raise ValueError(f"the limit must be in 1..{MOST_ROWS}")
    table, order, kinds = PURPOSES[purpose]
    df = _purpose(spark, root, table, run_id, **equal)
    df = df.withColumns({c.removesuffix("_json"): F.from_json(c, t) for c, t in kinds.items()}).drop(*kinds)
    days = [c for c in ("as_of", "fill_date") if c in df.columns]
    return page(df, order, limit, offset, start if days else None, end if days else None, days[0] if days else "as_of")


def run_report(spark: SparkSession, root: str, run_ids: Sequence[str] | None = None) -> DataFrame:
    """(run_id, model, strategy, cost_scenario, section, metric, value): what a run's tables say, from one grouped pass over each.

    Sections: ``count`` (rows by table), ``fold`` (mean, deviation and worst of each fold metric),
    ``strategy`` (the results as they are), ``equity`` (first and last date as day numbers, last value,
    deepest fall), ``trading`` (trades, notional, costs), ``weights`` (names and largest weight by
    date, averaged), ``overfitting``.  Absent tables have no rows.
    """
    keys = ["run_id", "model", "strategy", "cost_scenario"]
    out = None

    def table(name: str) -> DataFrame | None:
        try:
            df = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
        except Exception as e:  # a table that nothing was written to yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return df if run_ids is None else df.where(F.col("run_id").isin(list(run_ids)))

    def add(df: DataFrame, section: str, by: Sequence[str], values: Mapping[str, Column] | None = None, metric: str | None = None) -> None:
        nonlocal out
        if values is not None:
            df = df.groupBy(*by, *([metric] if metric else [])).agg(*[v.cast("double").alias(n) for n, v in values.items()])
            df = df.unpivot([*by, *([metric] if metric else [])], list(values), "_m", "value")
            df = df.withColumn("metric", F.concat_ws("_", *([metric] if metric else []), "_m"))
        rows = df.select(*[F.col(k) if k in by else F.lit(None).cast("string").alias(k) for k in keys], F.lit(section).alias("section"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)

    for name in TABLES:
        df = table(name)
        if df is None:
            continue
        by = [k for k in keys if k in df.columns]
        add(df, "count", ["run_id"], {name: F.count("*")})
        if name == "fold_metric":
            add(df, "fold", by, {"mean": F.avg("value"), "sd": F.stddev_samp("value"), "worst": F.min("value")}, "metric")
        elif name in ("strategy_result", "overfitting_metric"):
            add(df, "strategy" if name == "strategy_result" else "overfitting", by)
        elif name == "strategy_equity":
            w = Window.partitionBy(*by).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
            fall = df.withColumn("_f", F.try_divide(F.col("value"), F.max("value").over(w)) - 1)
            add(fall, "equity", by, {"first_day": F.min(F.unix_date("as_of")), "last_day": F.max(F.unix_date("as_of")), "last_value": F.max_by("value", "as_of"), "max_drawdown": F.min("_f")})
        elif name == "trade":
            add(df, "trading", by, {"trades": F.count("*"), "notional": F.sum(F.abs("notional")), "cost": F.sum(sum((F.coalesce(c, F.lit(0.0)) for c in ("commission", "spread_cost", "slippage_cost", "impact_cost")), F.lit(0.0)))})
        elif name == "target_weight":
            daily = df.groupBy(*by, "as_of").agg(F.count_if(F.col("weight") != 0).alias("_n"), F.max("weight").alias("_w"))
            add(daily, "weights", by, {"mean_names": F.avg("_n"), "mean_largest": F.avg("_w")})
    if out is None:
        raise LookupError(f"no results under {root}")
    return out


def write_report(report: DataFrame, path: str) -> None:
    """A report as Parquet by run, and as CSV; one report has a few hundred rows a run."""
    report.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/parquet")
    report.orderBy("run_id", "section", "model", "strategy", "cost_scenario", "metric").write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0, start: date | None = None, end: date | None = None, day: str = "as_of", **equal) -> tuple[DataFrame, int]:
    """(one page in a fixed order, total number of rows)."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def run_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(run_id, table, n)."""
    out = None
    for name, df in tables.items():
        c = df.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(name).alias("table"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def comparison(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A row for each key with a column a metric."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value")).orderBy(*keys)


def run_states(log: DataFrame, now=None, stale_after_hours: float = 6.0) -> DataFrame:
    """(run_id, state, at): the latest logged state; runs that say RUNNING for too long are FAILED."""
    by = log.groupBy("run_id").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))
    if now is None:
        return by
    late = (F.col("state") == "RUNNING") & (F.col("at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(stale_after_hours * 3600)} SECONDS"))
    return by.withColumn("state", F.when(late, "FAILED").otherwise(F.col("state")))


def list_runs(log: DataFrame, state: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    df = run_states(log)
    if state is not None:
        df = df.where(F.col("state") == state)
    return df.orderBy(F.col("at").desc(), "run_id").offset(offset).limit(limit)


def lineage(runs: DataFrame, artifacts: DataFrame, run_id: str, model: str, charter_hash: str, fold_hash: str) -> DataFrame:
    """One row of checks: run_exists, completed, has_artifact, charter_matches, folds_match, ok."""
    r = runs.where(F.col("run_id") == run_id).agg(F.count("*").alias("n"), F.max_by("state", "at").alias("state"), F.max_by("charter_hash", "at").alias("ch"))
    a = artifacts.where((F.col("run_id") == run_id) & (F.col("model") == model)).agg(F.count("*").alias("k"), F.coalesce(F.bool_and(F.col("fold_hash") == fold_hash), F.lit(False)).alias("folds_match"))
    out = r.crossJoin(a).select((F.col("n") > 0).alias("run_exists"), F.coalesce(F.col("state") == "COMPLETED", F.lit(False)).alias("completed"), (F.col("k") > 0).alias("has_artifact"), F.coalesce(F.col("ch") == charter_hash, F.lit(False)).alias("charter_matches"), "folds_match")
    ok = F.lit(True)
    for c in out.columns:
        ok = ok & F.col(c)
    return out.withColumn("ok", ok)


def to_json(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*columns)))


def status_counts(log: DataFrame) -> DataFrame:
    return run_states(log).groupBy("state").agg(F.count("*").alias("n"))
