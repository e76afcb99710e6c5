"""Shuffled micro-batches against the batch operator."""

import os
import random
from datetime import datetime, timedelta

import pytest

from panelspark.operators import ledger
from panelspark.streaming import streams

FILL = "event_id long, account string, security_id string, ts timestamp, side string, quantity double, price double, cost double"
START = datetime(2024, 1, 1)


def fills(n, seed):
    rnd = random.Random(seed)
    return [(i, f"a{rnd.randint(0, 2)}", f"s{rnd.randint(0, 2)}", START + timedelta(minutes=rnd.randint(0, 600)), rnd.choice(["buy", "sell"]), float(rnd.randint(1, 9)) if rnd.random() > 0.03 else None, round(rnd.uniform(5, 20), 2), 0.1) for i in range(n)]


@pytest.fixture()
def rocks(spark):
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, was)


def run(spark, tmp, batches, late):
    source, seen = f"{tmp}/in", {}
    os.makedirs(source)
    stream = spark.readStream.schema(FILL).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch, number):
        for r in batch.collect():
            seen[r["account"], r["security_id"]] = r

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FILL).coalesce(1).write.mode("append").parquet(source)
        q = streams.ordered_positions(stream, late).writeStream.outputMode("update").option("checkpointLocation", f"{tmp}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
    return seen


def test_shuffled_batches_fold_as_one(spark, rocks, tmp_path):
    rows = fills(150, 3)
    # within three hours of each other's order, dealt to batches out of order
    mixed = sorted(rows, key=lambda r: r[3] + timedelta(minutes=random.Random(r[0]).randint(0, 170)))
    batches = [mixed[i : i + 50] for i in range(0, 150, 50)]
    end = [(10_000, "end", "end", START + timedelta(days=3), "buy", 1.0, 1.0, 0.0)]  # moves the watermark past all others
    seen = run(spark, tmp_path, [*batches, end, [(10_001, "end", "end", START + timedelta(days=6), "buy", 1.0, 1.0, 0.0)]], "3 hours")
    want = {(r["account"], r["security_id"]): r for r in ledger.positions(spark.createDataFrame(rows, FILL)).collect()}
    got = {k: v for k, v in seen.items() if k[0] != "end"}
    assert set(got) == set(want)
    for k, r in want.items():
        for c in ("quantity", "cash", "average_cost", "realised"):
            assert got[k][c] == pytest.approx(r[c], abs=1e-9), (k, c)
        assert got[k]["waiting"] == 0
