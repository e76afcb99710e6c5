"""Runs a registered query and its SQL on the same files and compares the rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


def duck(d: str = DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or type(x).__module__ == "numpy" and hasattr(x, "item") and isinstance(x.item(), (int, float)):
            return f"{float(x):.6f}".replace("-0.000000", "0.000000")
        if type(x).__name__ == "Decimal":
            return f"{float(x):.6f}"
        return str(x).replace(" 00:00:00", "")[:40]

    return sorted(tuple(value(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(spark, query, sql: str, d: str = DIR) -> None:
    got, want = query(spark, d).toPandas(), duck(d).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
