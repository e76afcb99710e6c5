"""Data-quality checks. Each gives (check, severity, dataset, n, examples); ``report`` puts them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID, in_order

EXAMPLES = 5


def _finding(bad: DataFrame, check: str, severity: str, dataset: str, example: Column) -> DataFrame:
    """One row: how many rows are bad, with the first few examples by order of text."""
    rows = bad.select(example.cast("string").alias("_e"))
    firsts = rows.orderBy(F.col("_e").asc_nulls_last()).limit(EXAMPLES).agg(F.sort_array(F.collect_list("_e")).alias("examples"))  # EXAMPLES rows
    n = rows.agg(F.count("*").alias("n"))
    return n.crossJoin(firsts).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"), "n", "examples")


def _at(*columns: str) -> Column:
    return F.concat_ws("@", *[F.col(c).cast("string") for c in columns])


def duplicate_records(df: DataFrame, keys: Sequence[str], dataset: str) -> DataFrame:
    return _finding(df.groupBy(*keys).count().where("count > 1"), "duplicate_records", "critical", dataset, _at(*keys))


def price_values(prices: DataFrame, dataset: str = "prices") -> DataFrame:
    """invalid_price, invalid_volume, invalid_ohlc and their counts in one pass over the bars."""
    rules = {
        "invalid_price": F.col("close") <= 0,
        "invalid_volume": F.col("volume") < 0 if "volume" in prices.columns else F.lit(False),
        "invalid_ohlc": F.col("high") < F.col("low") if {"high", "low"} <= set(prices.columns) else F.lit(False),
    }
    bad = prices.select(_at(ID, DATE).alias("_e"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("check"))
    by = bad.groupBy("check").agg(F.count("*").alias("n"), F.min("_e").alias("_first"))
    names = prices.sparkSession.createDataFrame([(n,) for n in rules], "check string")
    return names.join(by, "check", "left").select("check", F.lit("critical").alias("severity"), F.lit(dataset).alias("dataset"), F.coalesce("n", F.lit(0)).alias("n"), F.array_compact(F.array("_first")).alias("examples"))


def extreme_returns(prices: DataFrame, most: float = 1.0, column: str = "close", dataset: str = "prices") -> DataFrame:
    r = F.try_divide(F.col(column), F.lag(column).over(in_order())) - 1
    return _finding(prices.withColumn("_r", r).where(F.abs("_r") > most), "extreme_return", "warning", dataset, _at(ID, DATE))


def adjustment_order(prices: DataFrame, dataset: str = "prices") -> DataFrame:
    """The cumulative factor must not fall over time (it grows to 1 as events pass)."""
    step = F.lag("cumulative_adjustment_factor").over(in_order()) - F.col("cumulative_adjustment_factor")
    return _finding(prices.withColumn("_s", step).where("_s > 1e-9"), "non_monotonic_adjustment", "warning", dataset, _at(ID, DATE))


def stale(prices: DataFrame, cal: DataFrame, sessions: int = 10, dataset: str = "prices") -> DataFrame:
    """Securities whose last bar is before the (sessions + 1)-th last session of the data."""
    days = cal.join(F.broadcast(prices.agg(F.max(DATE).alias("_m"))), F.col("session") <= F.col("_m"))
    edge = days.orderBy(F.col("session").desc()).limit(sessions + 1).agg(F.min("session").alias("_edge"))
    last = prices.groupBy(ID).agg(F.max(DATE).alias("last_date"))
    return _finding(last.join(F.broadcast(edge), F.col("last_date") < F.col("_edge")), "stale_observations", "warning", dataset, _at(ID, "last_date"))


def availability(df: DataFrame, now, dataset: str, key: str = ID) -> DataFrame:
    """impossible_availability (known before it was observed) and future_dated."""
    early = _finding(df.where(F.to_date("available_at") < F.col(DATE)), "impossible_availability", "critical", dataset, _at(key, DATE))
    late = _finding(df.where(F.col("available_at") > F.lit(now).cast("timestamp")), "future_dated", "critical", dataset, _at(key, DATE))
    return early.unionByName(late)


def missing_identifier(df: DataFrame, dataset: str, key: str = ID) -> DataFrame:
    text = F.col(key).cast("string")
    return _finding(df.where(text.isNull() | (F.char_length(F.trim(text)) == 0)), "missing_identifier", "critical", dataset, text)


def benchmark_gaps(benchmark: DataFrame, cal: DataFrame, most: float = 0.01, dataset: str = "benchmark") -> DataFrame:
    """Sessions within the benchmark's range that it lacks; critical if more than ``most`` of them."""
    span = benchmark.agg(F.min(DATE).alias("_a"), F.max(DATE).alias("_b"))
    due = cal.join(F.broadcast(span), F.col("session").between(F.col("_a"), F.col("_b"))).select("session")
    gaps = due.join(benchmark.select(F.col(DATE).alias("session")), "session", "left_anti")
    total = due.agg(F.count("*").alias("_t"))
    out = _finding(gaps, "benchmark_gaps", "warning", dataset, F.col("session")).crossJoin(total)
    return out.withColumn("severity", F.when(F.col("n") > F.col("_t") * most, "critical").otherwise("warning")).drop("_t")


def membership_overlap(membership: DataFrame, dataset: str = "membership") -> DataFrame:
    w = Window.partitionBy(ID, "universe").orderBy("start_date", "end_date")
    return _finding(membership.withColumn("_next", F.lead("start_date").over(w)).where("_next < end_date"), "membership_overlap", "critical", dataset, _at(ID, "start_date"))


def action_payload(actions: DataFrame, dataset: str = "corporate_actions") -> DataFrame:
    """invalid_corporate_action: splits and dividends without a positive value; invalid_symbol_change: no new symbol."""
    money = F.col("action_type").isin("stock_split", "cash_dividend") & (F.col("value").isNull() | (F.col("value") <= 0))
    out = _finding(actions.where(money), "invalid_corporate_action", "critical", dataset, _at(ID, "ex_date"))
    if "new_symbol" in actions.columns:
        change = (F.col("action_type") == "symbol_change") & F.col("new_symbol").isNull()
        out = out.unionByName(_finding(actions.where(change), "invalid_symbol_change", "critical", dataset, _at(ID, "ex_date")))
    return out


def calendar_mismatch(df: DataFrame, cal: DataFrame, dataset: str = "prices") -> DataFrame:
    """Rows on days that are not sessions, within the calendar's range."""
    span = cal.agg(F.min("session").alias("_a"), F.max("session").alias("_b"))
    inside = df.join(F.broadcast(span), F.col(DATE).between(F.col("_a"), F.col("_b")))
    return _finding(inside.join(F.broadcast(cal.select(F.col("session").alias(DATE))), DATE, "left_anti"), "calendar_mismatch", "warning", dataset, _at(ID, DATE))


def report(*findings: DataFrame) -> DataFrame:
    """All checks that found something."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def gate(findings: DataFrame) -> DataFrame:
    """The report; raises if it holds a critical finding."""
    bad = findings.where("severity = 'critical'").select("check", "dataset", "n").collect()  # a row a check
    if bad:
        raise ValueError("critical findings: " + ", ".join(f"{r['check']} in {r['dataset']} ({r['n']})" for r in bad))
    return findings


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``broken``: the names of the rules that a row breaks (a rule is a condition for a bad row)."""
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


#: By table, the conditions under which a row is bad.
ROW_RULES = {
    "prices": {"high_below_low": "high < low", "close_outside_range": "close > high OR close < low", "price_not_positive": "close <= 0", "negative_volume": "volume < 0"},
    "fundamentals": {"filed_before_period_end": "filing_date < fiscal_period_end", "known_before_filing": "to_date(available_at) < filing_date"},
    "labels": {"window_order": "window_end < window_start", "window_before_signal": "window_start < as_of"},
    "macro": {"revision_flag": "is_revision <> (revision_id > 0)"},
    "orders": {"order_before_signal": "order_date < signal_date", "quantity_not_positive": "quantity <= 0"},
}


def split_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``broken``) by the table's row rules."""
    marked = row_rules(df, {n: F.expr(c) for n, c in ROW_RULES[table].items()})
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)
