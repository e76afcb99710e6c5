"""Corporate actions, features without look-ahead, labels, splits, weights, costs, ledger, statistics."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.functions.scalars import normal_cdf, normal_quantile_column
from panelspark.operators import calendar, checks, corpactions, costs, identity, labels, ledger, metrics, models, overfit, preprocess, splits, weights
from panelspark.operators.features_price import price_features
from panelspark.sources import readers, writers

P = "security_id string, observation_date date, close double, volume double"


def bars(spark, n=40, start=date(2020, 1, 1), price=lambda i: 100.0 + i, ids=("A",)):
    rows = [(k, start + timedelta(i), float(price(i)), 1000.0) for k in ids for i in range(n)]
    return spark.createDataFrame(rows, P).withColumns({"adjusted_close": F.col("close"), "dollar_volume": F.col("close") * F.col("volume")})


def actions(spark, *rows):
    return spark.createDataFrame(rows, "security_id string, action_type string, ex_date date, value double")


def test_a_split_leaves_no_jump(spark):
    cut = date(2020, 1, 11)
    p = bars(spark, 20, price=lambda i: 100.0 if i < 10 else 50.0).drop("adjusted_close")
    a = corpactions.adjusted_prices(p, actions(spark, ("A", "stock_split", cut, 2.0)))
    assert {round(r["adjusted_close"], 9) for r in a.collect()} == {50.0}


def test_an_event_on_the_bars_own_day_does_not_touch_it(spark):
    a = corpactions.split_factors(bars(spark, 1), actions(spark, ("A", "stock_split", date(2020, 1, 1), 2.0)))
    assert a.first()["split_factor"] == 1.0


def test_dividends_use_the_last_close_before(spark):
    p = bars(spark, 3, price=lambda i: 100.0)
    a = corpactions.dividend_factors(p, actions(spark, ("A", "cash_dividend", date(2020, 1, 3), 1.0), ("A", "cash_dividend", date(2019, 1, 1), 1.0), ("B", "cash_dividend", date(2020, 1, 2), 1.0)))
    assert [round(r["dividend_factor"], 9) for r in a.orderBy("observation_date").collect()] == [0.99, 0.99, 1.0]


def test_features_never_look_ahead(spark):
    n = 300
    a = bars(spark, n, price=lambda i: 100 + 10 * math.sin(i))
    b = a.withColumns({c: F.when(F.col("observation_date") >= date(2020, 10, 1), F.col(c) * 3).otherwise(F.col(c)) for c in ("close", "adjusted_close", "volume")})
    bm = a.select("observation_date", "close")
    x, y = (price_features(p, bm).where("as_of < date'2020-10-01'").orderBy("as_of").collect() for p in (a, b))
    assert x == y and len(x) == 274


def test_bad_prices_give_nulls(spark):
    p = bars(spark, 30, price=lambda i: -1.0 if i == 5 else 100.0)
    rows = price_features(p, families=["momentum"]).orderBy("as_of").collect()
    assert rows[5]["reversal_5d"] is None and rows[10]["reversal_5d"] is None and rows[11]["reversal_5d"] == 0.0


def test_labels_of_the_delisted(spark):
    p = bars(spark, 60, price=lambda i: 100.0, ids=("A", "B", "C"))
    bm = bars(spark, 60, price=lambda i: 100.0).select("observation_date", "close")
    d = date(2020, 1, 20)
    s = spark.createDataFrame([("A", None, None), ("B", d, -1.0), ("C", d, 0.0)], "security_id string, delisting_date date, delisting_return double")
    rows = labels.forward_labels(p, bm, s, 10, 1).where("as_of = date'2020-01-15'").collect()
    got = {r["security_id"]: (round(r["raw_return"], 9), r["is_delisted"], r["window_end"]) for r in rows}
    assert got == {"A": (0.0, False, date(2020, 1, 26)), "B": (-1.0, True, d), "C": (0.0, True, d)}
    late = labels.forward_labels(p, bm, s, 10, 1).where("as_of >= date'2020-01-20' AND security_id = 'B'")
    assert late.count() == 0


def test_calendar(spark):
    cal = calendar.sessions(spark, date(2021, 12, 20), date(2022, 1, 10))
    days = [r["session"] for r in cal.orderBy("idx").collect()]
    assert date(2021, 12, 24) not in days and date(2021, 12, 31) in days and date(2022, 1, 1) not in days
    req = spark.createDataFrame([(date(2021, 12, 24),), (date(2022, 1, 10),)], "d date")
    assert {r["d"]: r["shifted"] for r in calendar.shifted(req, cal, "d", 1).collect()} == {date(2021, 12, 24): date(2021, 12, 28), date(2022, 1, 10): None}
    easter = spark.range(1).select(calendar.easter(F.lit(2024)).alias("e")).first()["e"]
    assert easter == date(2024, 3, 31)


def test_rename_intervals(spark):
    a = spark.createDataFrame([("X", "symbol_change", date(2020, 1, 1), "OLD", "MID"), ("X", "symbol_change", date(2021, 1, 1), "MID", "NEW")], "security_id string, action_type string, ex_date date, old_symbol string, new_symbol string")
    got = {(r["symbol"], r["start_date"], r["end_date"]) for r in identity.rename_intervals(a).collect()}
    assert got == {("OLD", date(1900, 1, 1), date(2020, 1, 1)), ("MID", date(2020, 1, 1), date(2021, 1, 1)), ("NEW", date(2021, 1, 1), date(9999, 12, 31))}


def test_preprocessing_uses_training_rows_only(spark):
    rows = [("s%d" % i, date(2020, 1, d), float(i)) for d in (1, 2) for i in range(11)] + [("s%d" % i, date(2021, 1, 1), 1000.0 + i) for i in range(11)]
    df = spark.createDataFrame(rows, "security_id string, as_of date, f double")
    st = preprocess.fit(df.where("as_of < date'2021-01-01'"), ["f"], q=0.0)
    assert st.first()["upper"] == 10.0
    out = preprocess.winsorize(df, st, ["f"]).where("as_of = date'2021-01-01'")
    assert {r["f"] for r in out.collect()} == {10.0}
    holes = spark.createDataFrame([("a", date(2021, 1, 1), None), ("b", date(2021, 1, 1), float("nan"))], "security_id string, as_of date, f double")
    assert [r["f"] for r in preprocess.impute(holes, st, ["f"]).collect()] == [5.0, 5.0]


def test_purge_and_embargo(spark):
    days = [date(2020, 1, 1) + timedelta(i) for i in range(1200)]
    panel = spark.createDataFrame([("A", d, d + timedelta(30)) for d in days], "security_id string, as_of date, window_end date")
    s = splits.folds(spark, date(2020, 1, 1), date(2023, 3, 1), splits.Schedule(1, 6, 6, 6))
    cal = calendar.numbered(spark.createDataFrame([(d,) for d in days], "session date"))
    out = splits.split_panel(panel, s, cal, embargo=40)
    assert all(r["ok"] for r in splits.fold_report(out, s).collect())
    splits.assert_safe(out, s)
    first = out.where("fold = 0 AND split = 'train'").agg(F.max("as_of")).first()[0]
    assert first == s.where("fold = 0").first()["validation_start"] - timedelta(41)
    with pytest.raises(PermissionError):
        splits.holdout_rows(panel, date(2022, 1, 1))
    with pytest.raises(ValueError):
        splits.assert_untouched(panel, date(2022, 1, 1))


@pytest.mark.parametrize("cap,floor", [(0.3, 0.0), (0.2, 0.05), (0.1, 0.0), (1.0, 0.0)])
def test_capped_weights_are_the_loops_fixed_point(spark, cap, floor):
    scores = [9.0, 5.0, 4.0, 1.0, 0.5, 0.1]
    df = spark.createDataFrame([("n%d" % i, date(2020, 1, 1), s) for i, s in enumerate(scores)], "security_id string, as_of date, score double")
    got = [r["weight"] for r in weights.capped(df, cap, floor).orderBy("security_id").collect()]
    w = [floor + (1 - floor * 6) * s / sum(scores) for s in scores]
    full: set = set()
    for _ in range(50):
        full |= {i for i, x in enumerate(w) if x > cap + 1e-12}
        free = [i for i in range(6) if i not in full]
        rest = 1 - cap * len(full) - floor * len(free)
        total = sum(scores[i] for i in free)
        w = [cap if i in full else floor + max(rest, 0) * scores[i] / total for i in range(6)]
    assert got == pytest.approx([min(x, cap) for x in w], abs=1e-9)


def test_costs_grow_with_scenarios_and_size(spark):
    t = spark.createDataFrame([(100.0, 50.0, 1e6, 0.3), (-100.0, 50.0, None, None), (0.0, 50.0, 1e6, 0.3)], "shares double, reference_price double, adv double, volatility double")
    rows = costs.with_costs(t).collect()
    base = {r["shares"]: r for r in rows if r["cost_scenario"] == "base"}
    assert base[100.0]["effective_price"] > 50 > base[-100.0]["effective_price"] and base[0.0]["total_cost"] == 0
    assert all(r["total_cost"] == 0 for r in rows if r["cost_scenario"] == "zero")
    triple = next(r for r in rows if r["cost_scenario"] == "triple" and r["shares"] == 100)
    assert triple["total_cost"] == pytest.approx(3 * base[100.0]["total_cost"])


def test_average_cost(spark):
    t = [datetime(2024, 1, 1, h) for h in range(4)]
    f = spark.createDataFrame([(1, t[0], "a", "X", "buy", 10.0, 10.0), (2, t[1], "a", "X", "buy", 10.0, 20.0), (3, t[2], "a", "X", "sell", 5.0, 30.0), (4, t[3], "a", "X", "sell", 15.0, 10.0)], "event_id long, ts timestamp, account string, security_id string, side string, quantity double, price double")
    r = ledger.positions(f.withColumn("cost", F.lit(0.0))).first()
    assert (r["quantity"], r["realised"], r["cash"], r["average_cost"]) == (0.0, 5 * 15.0 - 15 * 5.0, -300.0 + 150 + 150, 0.0)


def test_positions_keep_to_their_keys_in_any_order(spark):
    from random import Random

    rng = Random(5)
    fills = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(400)), rng.choice("ab"), rng.choice(["X", "Y", None]), rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(5, 50)), 0.5) for i in range(600)]
    schema = "event_id long, ts timestamp, account string, security_id string, side string, quantity double, price double, cost double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # positions run over several batches
    try:
        got = {(r["account"], r["security_id"]): r for r in ledger.positions(spark.createDataFrame(fills, schema).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({(f[2], f[3]) for f in fills})
    for key, row in got.items():
        q = cash = avg = pnl = 0.0
        for _, _, _, _, side, n, p, c in sorted((f for f in fills if (f[2], f[3]) == key), key=lambda f: (f[1], f[0])):
            if side == "sell":
                pnl += min(n, max(q, 0.0)) * (p - avg)
                q, cash = q - n, cash + n * p - c
                avg = avg if q > 0 else 0.0
            else:
                avg = (q * avg + n * p) / (q + n) if q + n > 0 else 0.0
                q, cash = q + n, cash - n * p - c
        assert [row[c] for c in ("quantity", "cash", "average_cost", "realised")] == pytest.approx([q, cash, avg, pnl])
    sums = {(r["account"], r["security_id"]): (r["quantity"], r["cash"]) for r in ledger.balances(spark.createDataFrame(fills, schema)).collect()}
    assert sums == {k: pytest.approx((r["quantity"], r["cash"])) for k, r in got.items()}
    assert ledger.positions(spark.createDataFrame([], schema)).count() == 0


def test_rows_over_the_sessions_they_hold(spark):
    cal = calendar.numbered(spark.createDataFrame([(date(2024, 1, n),) for n in (2, 3, 5, 8)], "session date"))
    rows = spark.createDataFrame(
        [("in", date(2024, 1, 3), date(2024, 1, 8)), ("open", date(2024, 1, 4), None), ("early", date(2023, 1, 1), date(2024, 1, 1)), ("late", date(2024, 1, 9), None), ("none", None, date(2024, 1, 5)), ("far", date(2024, 1, 1), date(9999, 12, 31)), ("gap", date(2024, 1, 6), date(2024, 1, 7)), ("back", date(2024, 1, 8), date(2024, 1, 2))],
        "k string, start_date date, end_date date")

    def days(closed):
        out = {}
        for r in calendar.spanned(rows.where("k <> 'far' OR NOT " + str(closed)), cal, "start_date", "end_date", closed=closed).collect():
            out.setdefault(r["k"], set()).add(r["as_of"].day)
        return out

    assert days(False) == {"in": {3, 5}, "open": {5, 8}, "far": {2, 3, 5, 8}}
    assert days(True) == {"in": {3, 5, 8}, "open": {5, 8}}


def test_statistics(spark):
    r = spark.createDataFrame([("s", date(2020, 1, 1) + timedelta(i), x) for i, x in enumerate([0.1, -0.5, 0.2, -1.0, 0.3])], "strategy string, as_of date, net_return double")
    row = metrics.bundle(r, ["strategy"], b=None).first()
    assert row["cumulative_return"] == -1 and row["max_drawdown"] == -1 and row["cagr"] == -1
    z = spark.createDataFrame([(x,) for x in (-5.0, -1.0, 0.0, 0.5, 2.0, 6.0)], "x double")
    for x in z.select("x", normal_cdf(F.col("x")).alias("p")).collect():
        assert x["p"] == pytest.approx(0.5 * math.erfc(-x["x"] / math.sqrt(2)), abs=1e-7)
    q = spark.createDataFrame([(0.001,), (0.3,), (0.975,), (0.0,)], "p double").select(normal_quantile_column(F.col("p")).alias("z")).collect()
    assert [x["z"] for x in q[:3]] == pytest.approx([-3.0902323, -0.5244005, 1.9599640], abs=1e-6) and q[3]["z"] is None
    noise = spark.range(400).selectExpr("id as t").crossJoin(spark.range(6).selectExpr("id as strategy")).withColumn("net_return", F.randn(3) * 0.01)
    p = overfit.pbo(noise, 8).first()
    assert p["n_splits"] == 70 and 0 <= p["pbo"] <= 1
    assert overfit.pbo(noise.where("strategy = 0"), 8).first()["pbo"] is None


def test_checks(spark):
    p = spark.createDataFrame([("A", date(2020, 1, 1), 1.0, 2.0, 1.0, 5.0), ("A", date(2020, 1, 1), -1.0, 1.0, 2.0, -5.0), ("", date(2020, 1, 2), 1.0, 2.0, 1.0, 5.0)], "security_id string, observation_date date, close double, high double, low double, volume double")
    f = checks.report(checks.duplicate_records(p, ["security_id", "observation_date"], "prices"), checks.price_values(p), checks.missing_identifier(p, "prices"))
    assert {r["check"]: r["n"] for r in f.collect()} == {"duplicate_records": 1, "invalid_price": 1, "invalid_volume": 1, "invalid_ohlc": 1, "missing_identifier": 1}
    with pytest.raises(ValueError, match="critical"):
        checks.gate(f)
    good, bad = checks.split_rows(p, "prices")
    assert good.count() == 2 and bad.first()["broken"] == ["high_below_low", "close_outside_range", "price_not_positive", "negative_volume"]


def test_models(spark):
    import random

    random.seed(1)
    rows = []
    for d in range(8):
        for i in range(30):
            x, z = random.gauss(0, 1), random.gauss(0, 1)
            rows.append(("s%d" % i, date(2020, 1, 1 + d), x, z, 0.5 * x + random.gauss(0, 0.1), 1.0 if x > 0 else 0.0))
    df = spark.createDataFrame(rows, "security_id string, as_of date, x double, z double, excess_return double, outperform double")
    m = models.elastic_net(df, ["x", "z"], "excess_return", alpha=1e-3)
    c = {r["feature"]: r["coefficient"] for r in m.coefficients(spark).collect()}
    assert c["x"] == pytest.approx(0.5, abs=0.02) and abs(c["z"]) < 0.05
    assert models.mean_ic(m.predict(df), df) > 0.9
    assert models.mean_ic(models.logistic(df, ["x", "z"]).predict(df), df) > 0.8
    with pytest.raises(ValueError, match="target"):
        models.elastic_net(df, ["x", "excess_return"], "excess_return")
    with pytest.raises(ValueError, match="drifted"):
        m.predict(df.drop("z"))
    with pytest.raises(ValueError, match="add up"):
        models.ensemble_weights({"a": 0.1, "b": 0.2}, cap=0.4)
    # clipped at the cap, the rest scaled in proportion
    w = models.ensemble_weights({"a": 0.7, "b": 0.2, "c": 0.1}, floor=0.0, cap=0.5)
    assert w["a"] == pytest.approx(0.5, abs=1e-6) and w["b"] / w["c"] == pytest.approx(2, abs=1e-6)
    w = models.ensemble_weights({"a": 0.2, "b": 0.1, "c": -0.3})
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0.05 - 1e-9 and max(w.values()) <= 0.6 + 1e-9


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "p.csv").write_text("security_id,observation_date,close,volume\nA,2020-01-02,10,5\nB,bad,x,1\n")
    p = readers.prices(readers.read_any(spark, str(tmp_path / "p.csv"), readers.schema("prices")))
    rows = {r["security_id"]: r for r in p.collect()}
    assert rows["A"]["dollar_volume"] == 50.0 and rows["A"]["available_at"] == datetime(2020, 1, 2, 21) and rows["B"]["close"] is None
    with pytest.raises(ValueError, match="lacks"):
        readers.prices(p.drop("close"))
    with pytest.raises(ValueError, match="lag"):
        readers.fundamentals(spark.createDataFrame([("A", date(2020, 1, 1))], "security_id string, fiscal_period_end date"))
    a, b = writers.digest(p).first(), writers.digest(p.orderBy(F.col("security_id").desc())).first()
    assert a == b != writers.digest(p.where("security_id = 'A'")).first()
    at = writers.snapshot(spark, str(tmp_path / "snap"), {"prices": p}, "files", "real")
    assert all(r["ok"] for r in writers.verify(spark, str(tmp_path / "snap"), at).collect())
    assert writers.snapshots(spark, str(tmp_path / "snap"), "files").first()["snapshot_id"] == at


def test_streams(spark, tmp_path):
    from panelspark.streaming import streams

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(hours=i), "a", "X", "buy" if i % 3 else "sell", 1.0, 10.0 + i) for i in range(60)]
    schema = "event_id long, ts timestamp, account string, security_id string, side string, quantity double, price double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run(streams.positions(src()), "update", "pos")
    assert got[0]["quantity"] == 20.0
    bars_ = run(streams.provisional_bars(src().withColumnRenamed("security_id", "ticker")), "append", "bars")
    assert {r["session_date"]: r["close"] for r in bars_} == {date(2024, 1, 1): 33.0, date(2024, 1, 2): 57.0}


def test_snapped_days_before_between_and_after_sessions(spark):
    from panelspark.operators import calendar

    cal = spark.createDataFrame([(date(2024, 1, 2), 0), (date(2024, 1, 5), 1), (date(2024, 1, 8), 2)], "session date, idx int")
    days = [date(2023, 12, 1), date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 5), date(2024, 1, 7), date(2024, 1, 9), None]
    got = {r["d"]: r["idx"] for r in calendar.snapped(spark.createDataFrame([(d,) for d in days], "d date"), cal, "d").collect()}
    assert [got[d] for d in days] == [0, 0, 1, 1, 2, None, None]


def test_verify_refuses_unknown_snapshots(spark, tmp_path):
    writers.snapshot(spark, str(tmp_path), {"t": spark.createDataFrame([(1,)], "a int")}, "s", "p")
    with pytest.raises(ValueError, match="no snapshot"):
        writers.verify(spark, str(tmp_path), "other")


def test_fundamentals_without_availability_take_the_filing(spark):
    rows = [("A", date(2020, 3, 31), date(2020, 5, 1), None), ("B", date(2020, 3, 31), date(2020, 5, 1), datetime(2020, 6, 1, 9))]
    df = readers.fundamentals(spark.createDataFrame(rows, "security_id string, fiscal_period_end date, filing_date date, available_at timestamp"))
    assert {r["security_id"]: r["available_at"] for r in df.collect()} == {"A": datetime(2020, 5, 1, 17), "B": datetime(2020, 6, 1, 9)}


def test_shared_folder_where_none_is_set():
    from types import SimpleNamespace as Fake

    from panelspark.sources import shared

    def session(master):
        return Fake(conf=Fake(get=lambda key, default: default), sparkContext=Fake(master=master))

    at = shared.folder(session("local[2]"))
    assert at.startswith("file://") and at == shared.folder(session("local[2]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.folder(session("spark://host:7077"))


def test_labels_at_signals_are_those_of_every_session(spark):
    import random

    rnd = random.Random(5)
    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    rows = [(s, day(t), None if rnd.random() < 0.05 else 10 + s + rnd.random()) for s in range(6) for t in range(s * 9, 120) if rnd.random() < 0.6]
    rows += [(2, day(500), 3.0)]  # no session
    bars = spark.createDataFrame(rows, "security_id long, observation_date date, adjusted_close double")
    bench = spark.createDataFrame([(day(t), 100.0 + t % 7) for t in range(0, 120, 1) if t % 7 < 5], "observation_date date, close double")
    sec = spark.createDataFrame([(0, day(30), -0.4), (1, day(105), None), (2, None, None), (3, day(119), 0.1)], "security_id long, delisting_date date, delisting_return double")
    signals = bench.where("day(observation_date) IN (3, 10, 24)").select(F.col("observation_date").alias("as_of")).unionByName(spark.createDataFrame([(day(700),)], "as_of date"))
    every = labels.forward_labels(bars, bench, sec, 10, 2).join(signals, "as_of", "left_semi")
    some = labels.forward_labels(bars, bench, sec, 10, 2, signals)
    cols = sorted(some.columns)
    a, b = (sorted(map(tuple, d.select(cols).collect()), key=str) for d in (every, some))
    assert len(a) > 12 and a == b and any(r[cols.index("is_delisted")] for r in a)


def test_a_lag_fills_missing_filing_dates(spark):
    rows = [("a", date(2020, 3, 31), date(2020, 5, 1), 1.0), ("a", date(2020, 6, 30), None, 2.0)]
    f = spark.createDataFrame(rows, "security_id string, fiscal_period_end date, filing_date date, revenue double")
    got = {r["revenue"]: r["available_at"] for r in readers.fundamentals(f, lag_days=60).collect()}
    assert got == {1.0: datetime(2020, 5, 1, 17), 2.0: datetime(2020, 8, 29)}
    assert readers.fundamentals(f).where("available_at IS NULL").count() == 1
    with pytest.raises(ValueError):
        readers.fundamentals(f.drop("filing_date"))


def test_instants_are_of_the_latest_period(spark):
    from panelspark.operators import facts

    rows = [("c", "total_assets", date(2020, 3, 31), date(2020, 9, 1), 1.0), ("c", "total_assets", date(2020, 6, 30), date(2020, 8, 1), 2.0), ("c", "total_assets", date(2020, 6, 30), date(2020, 8, 5), 3.0)]
    df = spark.createDataFrame(rows, "company string, concept string, end date, filed date, value double")
    assert facts.latest_instant(df).first()["value"] == 3.0  # not the restated older period that was filed last
