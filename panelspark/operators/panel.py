"""The research panel (universe, features and labels on one key) and the panel that scores without labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.windows import ID

KEY = ["as_of", ID]


def _own(df: DataFrame, taken: list[str]) -> DataFrame:
    """The key and the columns that are not there yet."""
    return df.select(*KEY, *[c for c in df.columns if c not in KEY and c not in taken])


def scoring_panel(universe: DataFrame, features: DataFrame) -> DataFrame:
    """Eligible names with their features and no labels; a name without a feature row keeps nulls."""
    return universe.join(_own(features, universe.columns), KEY, "left")


def research_panel(universe: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Eligible names with features and a label; names and dates without a whole label window are left out."""
    rows = scoring_panel(universe, features)
    return rows.join(_own(labels, rows.columns), KEY)


def latest(panel: DataFrame) -> DataFrame:
    """The rows of the newest date."""
    last = panel.agg(F.max("as_of").alias("_d"))
    return panel.join(F.broadcast(last), F.col("as_of") == F.col("_d")).drop("_d")
