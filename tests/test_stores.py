"""Gated snapshots, content-keyed panels, purpose queries and run reports."""

import hashlib
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelspark.operators import results
from panelspark.sources import writers

BARS = "security_id string, observation_date date, close double, volume long"


def bars(spark, extra=()):
    rows = [(f"s{i}", date(2020, 1, 1 + t), 10.0 + i + t, 100 * t) for i in range(5) for t in range(12)]
    return spark.createDataFrame(rows + list(extra), BARS)


def take(spark, root, df):
    rules = {"prices": {"close_not_positive": F.col("close") <= 0, "volume_negative": F.col("volume") < 0}}
    return writers.gated_snapshot(spark, root, {"prices": df}, {"prices": ["observation_date", "security_id"]}, rules, "vendor", "real")


def test_snapshot_is_ordered_and_the_same_for_the_same_content(spark, tmp_path):
    root = str(tmp_path / "snap")
    sid, found = take(spark, root, bars(spark).repartition(7))
    assert set(found["prices"].values()) == {0} and set(found["prices"]) == {"null_key", "close_not_positive", "volume_negative", "repeated_key"}
    again, _ = take(spark, root, bars(spark).orderBy(F.rand(3)))
    assert again == sid and writers.manifest(spark, root).count() == 1
    where = f"{root}/data/snapshot={sid}/prices"
    files = sorted(f for f in os.listdir(where) if f.endswith(".parquet"))
    lines = [tuple(r) for f in files for r in spark.read.parquet(f"{where}/{f}").collect()]
    assert [(r[1], r[0]) for r in lines] == sorted((r[1], r[0]) for r in lines) and len(lines) == 60
    assert writers.in_order(spark, root, sid, "prices")
    # the digest by hand, over the rows as they lie
    cols = sorted(c for c in ("security_id", "observation_date", "close", "volume"))
    flat = spark.createDataFrame([(i, *r) for i, r in enumerate(lines)], "i long, " + BARS)
    s = flat.select(F.sum(F.xxhash64("i", *[p for c in cols for p in (F.col(c).isNull(), F.col(c))]).cast("decimal(38,0)"))).first()[0]
    names = ",".join(f"{c}:{dict(bars(spark).dtypes)[c]}" for c in cols)
    row = writers.manifest(spark, root).first()
    assert row["digest"] == hashlib.sha256(f"{names}|ordered|60|{s}".encode()).hexdigest() and row["n"] == 60
    # the same rows in another order have another digest, and the order-free one is the same
    turned = spark.read.parquet(where).orderBy(F.col("observation_date").desc(), "security_id")
    turned.coalesce(1).write.parquet(str(tmp_path / "turned"))
    other = spark.read.parquet(str(tmp_path / "turned"))
    assert writers.ordered_digest(other).first()["digest"] != row["digest"]
    assert writers.digest(other).first()["digest"] == writers.digest(spark.read.parquet(where)).first()["digest"]
    other.write.mode("overwrite").parquet(where)
    assert not writers.in_order(spark, root, sid, "prices")


@pytest.mark.parametrize("bad, rule", [(("s9", date(2020, 1, 1), -1.0, 1), "close_not_positive"), (("s9", date(2020, 1, 1), 1.0, -1), "volume_negative"), (("s1", date(2020, 1, 3), 5.0, 1), "repeated_key"), ((None, date(2020, 1, 3), 5.0, 1), "null_key")])
def test_a_bad_table_leaves_no_snapshot(spark, tmp_path, bad, rule):
    root = str(tmp_path / "snap")
    with pytest.raises(ValueError, match=f"prices.{rule}': 1"):
        take(spark, root, bars(spark, [bad]))
    left = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs]
    assert not left
    take(spark, root, bars(spark).limit(0))  # an empty table is a snapshot of no rows


def test_panels_by_content(spark, tmp_path):
    root, calls = str(tmp_path / "cache"), []
    panel = bars(spark).withColumns({"fold": F.pmod(F.dayofmonth("observation_date"), F.lit(3)), "split": F.when(F.col("volume") > 500, "test").otherwise("train")})

    def make():
        calls.append(1)
        return {"folds": panel, "days": panel.select("observation_date").distinct()}

    key = writers.content_key({"bars": bars(spark)}, {"horizon": 21, "features": ["a", "b"], "start": date(2020, 1, 1)})
    first, was = writers.keyed_panels(spark, root, key, make)
    second, now = writers.keyed_panels(spark, root, key, make)
    assert (was, now, len(calls)) == (False, True, 1)
    assert sorted(map(tuple, second["folds"].select(panel.columns).collect())) == sorted(map(tuple, panel.collect())) and second["days"].count() == 12
    one = second["folds"].where("fold = 1 AND split = 'test'")
    assert "PartitionFilters: [isnotnull(fold" in one._jdf.queryExecution().toString() and one.count() == panel.where("fold = 1 AND split = 'test'").count()
    # order of rows is no content, values and settings are
    assert key == writers.content_key({"bars": bars(spark).orderBy(F.rand(1))}, {"start": date(2020, 1, 1), "features": ["a", "b"], "horizon": 21})
    assert key != writers.content_key({"bars": bars(spark)}, {"horizon": 22, "features": ["a", "b"], "start": date(2020, 1, 1)})
    assert key != writers.content_key({"bars": bars(spark).withColumn("close", F.col("close") + 1)}, {"horizon": 21, "features": ["a", "b"], "start": date(2020, 1, 1)})

    def fails():
        raise RuntimeError("no panel")

    with pytest.raises(RuntimeError):
        writers.keyed_panels(spark, root, "other", fails)
    assert not os.path.exists(f"{root}/panel=other")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("results"))

    def add(table, rows):
        results.append(spark.createDataFrame(rows, results.TABLES[table]), root, table)

    for run in ("r1", "r2"):
        add("fold", [(run, f, *[date(2020, 1 + f, d) for d in (1, 2, 3, 4, 5, 6)]) for f in range(2)])
        add("fold_metric", [(run, m, f, "ic", 0.1 * f + (m == "b")) for m in "ab" for f in range(3)])
        add("strategy_equity", [(run, "a", "top", "base", date(2020, 1, d), v, None) for d, v in ((1, 100.0), (2, 120.0), (3, 90.0), (4, 110.0))])
        add("strategy_result", [(run, "a", "top", "base", "sharpe", 1.5), (run, "a", "set", "base", "sharpe", 0.5)])
        add("trade", [(run, "a", "top", "base", *[date(2020, 1, 5)] * 5, f"s{i}", "buy", 1.0, 10.0, 10.0, -50.0 * i, 1.0, 0.5, None, 0.25) for i in range(3)])
        add("target_weight", [(run, "a", "top", date(2020, 1, d), f"s{i}", w) for d in (1, 2) for i, w in enumerate((0.7, 0.3, 0.0))])
        add("optimizer_diagnostic", [(run, "a", "top", date(2020, 1, 1), "relaxed", '["turnover","sector"]'), (run, "a", "top", date(2020, 1, 2), "ok", None)])
        add("overfitting_metric", [(run, "a", "pbo", 0.2, '{"splits":"70"}')])
    add("research_run", [("r1", "COMPLETED", datetime(2020, 1, 1), "h", "s", "[]")])
    return root


def test_purpose_queries(spark, store):
    rows, n = results.ask(spark, store, "equity", "r1", limit=2, offset=1, model="a", strategy="top")
    assert n == 4 and [r["value"] for r in rows.collect()] == [120.0, 90.0]
    rows, n = results.ask(spark, store, "equity", "r1", start=date(2020, 1, 3))
    assert n == 2
    rows, n = results.ask(spark, store, "diagnostics", "r1")
    assert [r["relaxations"] for r in rows.collect()] == [["turnover", "sector"], None]
    assert results.ask(spark, store, "overfitting", "r2")[0].first()["details"] == {"splits": "70"}
    assert results.ask(spark, store, "folds", "none")[1] == 0
    assert [r["fold"] for r in results.ask(spark, store, "fold_metrics", "r1", model="b")[0].collect()] == [0, 1, 2]
    for purpose in ("fold_metrics", "weights", "trades", "strategy_metrics"):
        assert results.ask(spark, store, purpose, "r1")[1] > 0
    with pytest.raises(ValueError, match="no purpose"):
        results.ask(spark, store, "nothing", "r1")
    with pytest.raises(ValueError, match="limit"):
        results.ask(spark, store, "folds", "r1", limit=0)


def test_run_report(spark, store, tmp_path):
    report = results.run_report(spark, store)
    got = {(r["run_id"], r["section"], r["model"], r["strategy"], r["metric"]): r["value"] for r in report.collect()}
    assert got["r1", "count", None, None, "fold_metric"] == 6 and got["r1", "count", None, None, "research_run"] == 1
    assert got["r2", "fold", "b", None, "ic_mean"] == pytest.approx(1.1) and got["r2", "fold", "a", None, "ic_worst"] == 0 and got["r1", "fold", "a", None, "ic_sd"] == pytest.approx(0.1)
    assert got["r1", "equity", "a", "top", "max_drawdown"] == pytest.approx(-0.25) and got["r1", "equity", "a", "top", "last_value"] == 110
    assert got["r1", "trading", "a", "top", "cost"] == pytest.approx(5.25) and got["r1", "trading", "a", "top", "notional"] == 150 and got["r1", "trading", "a", "top", "trades"] == 3
    assert got["r1", "weights", "a", "top", "mean_names"] == 2 and got["r1", "weights", "a", "top", "mean_largest"] == pytest.approx(0.7)
    assert got["r1", "strategy", "a", "set", "sharpe"] == 0.5 and got["r2", "overfitting", "a", None, "pbo"] == 0.2
    assert {r["run_id"] for r in results.run_report(spark, store, ["r2"]).collect()} == {"r2"}
    results.write_report(report, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet")).where("run_id = 'r1'").count() == report.where("run_id = 'r1'").count()
    with pytest.raises(LookupError):
        results.run_report(spark, str(tmp_path / "empty"))


def test_select_only_judges_the_plan_not_the_words(spark, store):
    ask = lambda sql: results.select_only(spark, store, sql).collect()
    assert ask("SELECT value FROM strategy_result WHERE strategy = 'set' AND run_id = 'r1'")[0]["value"] == 0.5
    assert ask("WITH t AS (SELECT * FROM fold) SELECT count(*) AS n FROM t;")[0]["n"] == 4
    assert ask("SELECT 'drop table x; delete' AS t, (SELECT max(value) FROM strategy_equity) AS m")[0]["m"] == 120
    for sql in ("DROP TABLE fold", "SELECT 1; SELECT 2", "INSERT INTO fold SELECT * FROM fold", "SET a = b", "CREATE VIEW v AS SELECT 1", "WITH t AS (SELECT 1) INSERT INTO fold SELECT * FROM t", "CACHE TABLE fold", "not sql", "", "DELETE FROM fold", "EXPLAIN SELECT 1"):
        with pytest.raises(ValueError, match="only one SELECT"):
            ask(sql)
