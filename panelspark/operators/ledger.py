"""Orders, decisions, fills and accounts as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from panelspark.functions.windows import ID
from panelspark.operators.costs import Costs, with_costs


def proposals(targets: DataFrame, current: DataFrame, quotes: DataFrame, value: float, least_trade: float = 0.0, costs: Costs = Costs()) -> DataFrame:
    """Orders from target and current weights: side, quantity, expected cost; sells are held to what is owned, small trades go."""
    t = targets.select(ID, F.col("weight").alias("target_weight"))
    c = current.select(ID, F.col("weight").alias("current_weight"), F.col("quantity").alias("owned"))
    zero = F.lit(0.0)
    df = t.join(c, ID, "full_outer").withColumns({x: F.coalesce(x, zero) for x in ("target_weight", "current_weight", "owned")})
    df = df.join(quotes.select(ID, F.col("price").alias("reference_price"), "adv", "volatility"), ID, "left").where(F.col("reference_price") > 0)
    want = (F.col("target_weight") - F.col("current_weight")) * value / F.col("reference_price")
    df = df.withColumn("shares", F.greatest(want, -F.greatest(F.col("owned"), zero)))
    df = with_costs(df.where(F.abs(F.col("shares") * F.col("reference_price")) > least_trade), costs, {"base": 1.0})
    side = F.when(F.col("shares") < 0, "sell").otherwise("buy")
    return df.select(ID, side.alias("side"), F.abs("shares").alias("quantity"), "target_weight", "current_weight", "reference_price", "notional", F.col("total_cost").alias("expected_cost"))


def participation_capped(orders: DataFrame, most_share: float) -> DataFrame:
    """Quantity held to a share of ADV, with ``partial``; orders without an ADV are left as they are."""
    most = F.when(F.col("adv") > 0, F.col("adv") * most_share / F.col("reference_price"))
    filled = F.least(F.col("quantity"), F.coalesce(most, F.col("quantity")))
    return orders.withColumns({"filled_quantity": filled, "partial": filled < F.col("quantity")})


def decisions(log: DataFrame) -> DataFrame:
    """(order_id, decision, at): the latest decision of each order; ties fall to the larger event id."""
    return log.groupBy("order_id").agg(F.max_by("decision", F.struct("at", "event_id")).alias("decision"), F.max("at").alias("at"))


def approved(orders: DataFrame, log: DataFrame) -> DataFrame:
    """Orders whose latest decision approves them; orders without a decision are never used."""
    return orders.join(decisions(log).where("decision = 'approve'").select("order_id"), "order_id", "left_semi")


def reconcile(orders: DataFrame, fills: DataFrame, most_gap: float = 0.01) -> DataFrame:
    """Each order with what was filled: fill_ratio, shortfall (price against the reference, by side), cost_gap and warnings."""
    f = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.try_divide(F.sum(F.col("quantity") * F.col("price")), F.sum("quantity")).alias("fill_price"), F.sum("cost").alias("realised_cost"))
    zero = F.lit(0.0)
    df = orders.join(f, "order_id", "left").withColumns({"filled": F.coalesce("filled", zero), "realised_cost": F.coalesce("realised_cost", zero)})
    sign = F.when(F.col("side") == "sell", -1.0).otherwise(1.0)
    df = df.withColumns({"fill_ratio": F.try_divide("filled", "quantity"), "shortfall": sign * (F.col("fill_price") - F.col("reference_price")) * F.col("filled"), "cost_gap": F.col("realised_cost") - F.col("expected_cost")})
    gap = F.coalesce(F.abs(F.try_divide("fill_price", "reference_price") - 1) > most_gap, F.col("fill_price") != F.col("reference_price"))  # beside a reference of 0 any other price is a gap
    rules = {"unfilled": F.col("filled") == 0, "partial": (F.col("filled") > 0) & (F.col("fill_ratio") < 1 - 1e-9), "price_gap": gap}
    return df.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def weight_gaps(targets: DataFrame, actual: DataFrame) -> DataFrame:
    """(security_id, target, actual, gap) over the union of names."""
    a, b = targets.select(ID, F.col("weight").alias("target")), actual.select(ID, F.col("weight").alias("actual"))
    zero = F.lit(0.0)
    return a.join(b, ID, "full_outer").select(ID, F.coalesce("target", zero).alias("target"), F.coalesce("actual", zero).alias("actual"), (F.coalesce("actual", zero) - F.coalesce("target", zero)).alias("gap"))


def rebalance_record(orders: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: counts by side, traded notional, expected cost and the target weights as a map."""
    o = orders.agg(F.count("*").alias("n_orders"), F.count_if(F.col("side") == "buy").alias("n_buys"), F.count_if(F.col("side") == "sell").alias("n_sells"), F.sum("notional").alias("traded"), F.sum("expected_cost").alias("expected_cost"), (F.sum(F.abs(F.col("target_weight") - F.col("current_weight"))) / 2).alias("turnover"))
    w = targets.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(ID).cast("string"), "weight")))).alias("target_weights"))  # names held at one rebalance
    return o.crossJoin(w)


def _signed() -> Column:
    return F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity")).cast("double")


def balances(fills: DataFrame) -> DataFrame:
    """(account, security_id, quantity, cash): signed sums, pre-aggregated before the exchange."""
    q = _signed()
    return fills.groupBy("account", ID).agg(F.sum(q).alias("quantity"), F.sum(-q * F.col("price") - F.coalesce("cost", F.lit(0.0))).alias("cash"))


def positions(fills: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(account, security_id, quantity, cash, average_cost, realised): sums and average cost by an ordered fold of each position's fills.

    Buys raise the average cost by their price; sells realise against it and leave it.
    Partitions are sorted, which may spill, and read as a stream with one position's sums in
    memory, however many fills it has.  A fill without quantity or price counts for nothing.
    """
    rows = fills.where("quantity IS NOT NULL AND price IS NOT NULL")
    rows = rows.select("account", ID, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], _signed().alias("_q"), F.col("price").cast("double").alias("_p"), F.coalesce("cost", F.lit(0.0)).cast("double").alias("_c"))
    rows = rows.repartition("account", ID).sortWithinPartitions("account", ID, *[f"_o{i}" for i in range(len(order))], "_q", "_p")

    def fold(batches):
        key, sums = None, [0.0] * 4
        for batch in batches:
            accounts, ids, *numbers = (c.to_pylist() for c in batch.columns)
            done = []
            for account, security, q, p, c in zip(accounts, ids, *numbers, strict=True):
                if key != (account, security):
                    if key is not None:
                        done.append((*key, *sums))
                    key, sums = (account, security), [0.0] * 4
                held, cash, avg, pnl = sums
                if q <= 0:
                    pnl += min(-q, max(held, 0.0)) * (p - avg)
                now = held + q
                if now <= 0:
                    avg = 0.0
                elif q > 0:
                    avg = (held * avg + q * p) / now
                sums = [now, cash - q * p - c, avg, pnl]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *sums), kinds, strict=True)], names)

    out = StructType([*rows.select("account", ID).schema.fields, *[StructField(c, DoubleType()) for c in ("quantity", "cash", "average_cost", "realised")]])
    kinds, names = list(to_arrow_schema(out).types), out.names
    return rows.select("account", ID, "_q", "_p", "_c").mapInArrow(fold, out)


def account_summary(held: DataFrame, quotes: DataFrame, cash: DataFrame) -> DataFrame:
    """(account, positions_value, unrealised, realised, cash, total_value)."""
    df = held.join(quotes.select(ID, "price"), ID, "left")
    by = df.groupBy("account").agg(F.sum(F.col("quantity") * F.col("price")).alias("positions_value"), F.sum(F.col("quantity") * (F.col("price") - F.col("average_cost"))).alias("unrealised"), F.sum("realised").alias("realised"))
    out = by.join(cash.groupBy("account").agg(F.sum("cash").alias("cash")), "account", "left").withColumn("cash", F.coalesce("cash", F.lit(0.0)))
    return out.withColumn("total_value", F.col("positions_value") + F.col("cash"))


def cost_surprise(reconciled: DataFrame) -> DataFrame:
    """One row: expected and realised costs and their ratio."""
    return reconciled.agg(F.sum("expected_cost").alias("expected"), F.sum("realised_cost").alias("realised")).withColumn("surprise", F.try_divide(F.col("realised"), F.col("expected")) - 1)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
