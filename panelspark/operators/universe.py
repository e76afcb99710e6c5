"""Point-in-time universe: membership, type, listing and liquidity screens for all signal dates in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import DATE, ID, in_order, rolling
from panelspark.operators.asof import as_of_join
from panelspark.operators.calendar import numbered, spanned


@dataclass(frozen=True)
class Screens:
    universe: str = "main"
    types: tuple[str, ...] = ("common_stock",)
    excluded_sectors: tuple[str, ...] = ()
    least_history: int = 252
    least_price: float = 5.0
    least_adv: float = 1e6
    adv_rows: int = 21
    most_age_days: int = 10
    top_n: int | None = None
    allow_biased: bool = False


RULES = ["security_type", "sector", "not_listed", "no_prices", "history", "price", "liquidity", "stale"]


def refuse_biased(membership: DataFrame, allowed: bool) -> None:
    """Raises if any membership row is marked survivorship-biased and that is not allowed."""
    if not allowed and "is_survivorship_biased" in membership.columns and membership.where("is_survivorship_biased").limit(1).count():
        raise ValueError("membership is survivorship-biased")


def members(dates: DataFrame, membership: DataFrame, universe: str) -> DataFrame:
    """(as_of, security_id) of the members on each date that were announced by its end."""
    m = membership.where(F.col("universe") == universe).select(ID, "start_date", "end_date", "available_at").where("end_date IS NOT NULL")
    cal = numbered(dates.select(F.col("as_of").alias("session")).where("session IS NOT NULL").distinct())
    hit = spanned(m, cal, "start_date", "end_date")
    announced = F.col("available_at").isNull() | (F.col("available_at") < F.date_add("as_of", 1).cast("timestamp"))
    return hit.where(announced).select("as_of", ID).distinct()


def bar_state(prices: DataFrame, s: Screens) -> DataFrame:
    """Each bar with the security's history so far, raw close and trailing dollar volume."""
    return prices.select(ID, F.col(DATE).alias("bar_date"), F.col("close").alias("last_close"), F.count("close").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("history"), rolling(F.avg, F.col("dollar_volume"), s.adv_rows, 1).alias("adv"))


def screened(dates: DataFrame, membership: DataFrame, securities: DataFrame, prices: DataFrame, s: Screens = Screens()) -> DataFrame:
    """Every member on every date with its screen values and ``excluded_by`` (null if eligible): the first rule that fails."""
    rows = members(dates, membership, s.universe).join(securities, ID, "left")
    rows = as_of_join(rows, bar_state(prices, s), ID, "as_of", "bar_date")
    at = F.col("as_of")
    fails = {
        "security_type": ~F.coalesce(F.col("security_type").isin(*s.types), F.lit(False)),
        "sector": F.coalesce(F.col("sector").isin(*s.excluded_sectors), F.lit(False)) if s.excluded_sectors else F.lit(False),
        "not_listed": F.coalesce((F.col("first_trade_date") > at) | (F.col("delisting_date") <= at), F.lit(False)),
        "no_prices": F.col("bar_date").isNull(),
        "history": F.col("history") < s.least_history,
        "price": F.coalesce(F.col("last_close") < s.least_price, F.lit(True)),
        "liquidity": F.coalesce(F.col("adv") < s.least_adv, F.lit(True)),
        "stale": F.datediff(at, "bar_date") > s.most_age_days,
    }
    return rows.withColumn("excluded_by", F.coalesce(*[F.when(fails[r], F.lit(r)) for r in RULES]))


def universe_panel(dates: DataFrame, membership: DataFrame, securities: DataFrame, prices: DataFrame, s: Screens = Screens()) -> DataFrame:
    """(as_of, security_id, sector, last_close, adv) of the eligible names, the top_n by adv if asked."""
    refuse_biased(membership, s.allow_biased)
    rows = screened(dates, membership, securities, prices, s).where("excluded_by IS NULL")
    if s.top_n is not None:
        w = Window.partitionBy("as_of").orderBy(F.col("adv").desc(), ID)
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= s.top_n)
    return rows.select("as_of", ID, "sector", "last_close", "adv")


def exclusion_report(screened_rows: DataFrame) -> DataFrame:
    """(as_of, rule, n) with rule 'eligible' for those that stay."""
    return screened_rows.groupBy("as_of", F.coalesce("excluded_by", F.lit("eligible")).alias("rule")).agg(F.count("*").alias("n"))


def selectivity(universe: DataFrame, most_holdings: int) -> DataFrame:
    """One row: the median universe size and whether it leaves a choice (at least twice the holdings)."""
    by = universe.groupBy("as_of").agg(F.count("*").alias("n"))
    return by.agg(F.median("n").alias("median_size")).withColumn("selective", F.col("median_size") >= 2 * most_holdings)

