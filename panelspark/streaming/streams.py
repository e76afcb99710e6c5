"""Structured Streaming versions of the append-only parts: fills, quotes, decisions, arriving bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.functions.windows import ID
from panelspark.operators import checks


def positions(fills: DataFrame) -> DataFrame:
    """(account, security_id, quantity, cash) in update mode: sums only, so arrival order does not matter."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    return fills.groupBy("account", ID).agg(F.sum(signed).alias("quantity"), F.sum(-signed * F.col("price")).alias("cash"))


def average_cost(fills: DataFrame, key_type: str = "string") -> DataFrame:
    """(account, security_id, quantity, average_cost, realised) after each batch, folding fills by event time within a batch.

    State is three numbers a position.  A fill that arrives in a later batch than one with
    a later time is applied when it comes.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, avg, pnl = state.get if state.exists else (0.0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for side, n, p in zip(rows["side"], rows["quantity"], rows["price"], strict=True):
            if side == "sell":
                pnl += min(n, max(q, 0.0)) * (p - avg)
                q -= n
                avg = avg if q > 0 else 0.0
            else:
                avg = (q * avg + n * p) / (q + n) if q + n > 0 else 0.0
                q += n
        state.update((q, avg, pnl))
        yield pd.DataFrame({"account": [key[0]], ID: [key[1]], "quantity": [q], "average_cost": [avg], "realised": [pnl]})

    schema = f"account {key_type}, {ID} {key_type}, quantity double, average_cost double, realised double"
    return fills.groupBy("account", ID).applyInPandasWithState(fold, schema, "q double, a double, r double", "update", GroupStateTimeout.NoTimeout)


class _OrderedFold(StatefulProcessor):
    """Fills wait until the watermark is past them and are then folded by (ts, event_id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, q double, p double, c double")
        self.sums = handle.getValueState("sums", "q double, cash double, avg double, pnl double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            part = part[part["quantity"].notna() & part["price"].notna()]
            at = part["ts"].astype("datetime64[us]").astype("int64")
            signed = part["quantity"].astype("float64").where(part["side"] != "sell", -part["quantity"].astype("float64"))
            new += list(zip(at.tolist(), part["event_id"].tolist(), signed.tolist(), part["price"].astype("float64").tolist(), part["cost"].fillna(0.0).astype("float64").tolist(), strict=True))
        if new:
            self.waiting.appendList(new)
            # one timer for each batch's first fill; a timer that finds nothing left to fold is harmless
            self.handle.registerTimer(min(r[0] for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] // 1000 <= passed]
        rest = rows[len(due) :]
        if not due:
            return
        held, cash, avg, pnl = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0.0, 0.0)
        for _, _, q, p, c in due:
            if q <= 0:
                pnl += min(-q, max(held, 0.0)) * (p - avg)
            now = held + q
            avg = 0.0 if now <= 0 else (held * avg + q * p) / now if q > 0 else avg
            held, cash = now, cash - q * p - c
        self.sums.update((held, cash, avg, pnl))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)
        else:
            self.waiting.clear()
        yield pd.DataFrame({"account": [key[0]], ID: [key[1]], "quantity": [held], "cash": [cash], "average_cost": [avg], "realised": [pnl], "until": [pd.Timestamp(due[-1][0], unit="us")], "waiting": [len(rest)]})

    def close(self) -> None:
        return


def ordered_positions(fills: DataFrame, late: str = "1 hour", key_type: str = "string") -> DataFrame:
    """(account, security_id, quantity, cash, average_cost, realised, until, waiting) in update mode, folded by event time across batches.

    A fill waits in its position's list until the watermark (``late`` behind the newest fill) is past
    it, so a fill that comes in a later batch than one with a later time is still folded before it,
    and the last row of a position is that of the batch operator for all fills until ``until``.  A
    fill that comes after the watermark is past it is dropped, as every late row is.  State is four
    numbers a position and the fills within ``late``.  Needs the RocksDB state store.
    """
    cost = F.col("cost") if "cost" in fills.columns else F.lit(0.0)
    rows = fills.select("account", ID, "ts", F.col("event_id").cast("long").alias("event_id"), "side", "quantity", "price", cost.cast("double").alias("cost"))
    schema = f"account {key_type}, {ID} {key_type}, quantity double, cash double, average_cost double, realised double, until timestamp, waiting long"
    return rows.withWatermark("ts", late).groupBy("account", ID).transformWithStateInPandas(_OrderedFold(), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def provisional_bars(quotes: DataFrame, late: str = "1 hour") -> DataFrame:
    """(ticker, session_date, close): the last price of each day, given out when the watermark passes it; later quotes are dropped."""
    day = F.window("ts", "1 day")
    by = quotes.withWatermark("ts", late).groupBy("ticker", day).agg(F.max_by("price", "ts").alias("close"))
    return by.select("ticker", F.to_date("window.start").alias("session_date"), "close")


def decisions(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(order_id, decision, at) in update mode; an event that comes twice within the watermark counts once."""
    once = log.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("order_id").agg(F.max_by("decision", F.struct("at", "event_id")).alias("decision"), F.max("at").alias("at"))


def quality_counts(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch's bar checks to a table; a batch that is retried replaces its own rows."""

    def check(batch: DataFrame, number: int) -> None:
        found = checks.price_values(batch).unionByName(checks.missing_identifier(batch, "prices"))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return check
