"""The upsert store: equal to upserts of whole tables, through splits, replays and crashes."""

import os
import random

from pyspark.sql import functions as F

from listinglab.sources.io import upsert_raw
from listinglab.streaming import store

RAW = "source string, deal_type string, external_id string, price_value double, collected_at int"


def batches(seed, n):
    rnd = random.Random(seed)
    return [[("s", rnd.choice(["sale", "rent"]), str(rnd.randrange(60)), rnd.choice([None, rnd.random()]), 10 * b + k) for k in range(rnd.randint(0, 25))] for b in range(n)]


def rows_of(df):
    return {} if df is None else {tuple(r[:3]): tuple(r[3:]) for r in df.select("source", "deal_type", "external_id", "price_value", "collected_at").collect()}


def test_store_equals_upserts_of_whole_tables(spark, tmp_path):
    folder = str(tmp_path / "store")
    run = store.upsert_batches(folder, every=3, bucket_rows=20)
    known = {}
    for n, rows in enumerate(batches(1, 10)):
        run(spark.createDataFrame(rows, RAW), n)
        for r in rows:  # the last of a key in a batch is that of the greatest collected_at
            known[r[:3]] = r[3:]
        assert rows_of(store.snapshot(spark, folder, n)) == known
    want = spark.createDataFrame([], RAW)
    for rows in batches(1, 10):
        want = spark.createDataFrame([tuple(r) for r in upsert_raw(want, spark.createDataFrame(rows, RAW), F.col("collected_at")).drop("action").select("source", "deal_type", "external_id", "price_value", "collected_at").collect()], RAW)
    assert rows_of(want) == known
    now = store.manifest(spark, folder, 99)
    assert now.upto == 8 and len(now.buckets) > 1  # split
    names = set(os.listdir(folder))
    assert "batch=0" not in names and {f"batch={k}" for k in range(6, 10)} <= names


def test_replays_and_crashes_give_the_same(spark, tmp_path):
    folder = str(tmp_path / "store")
    run, parts = store.upsert_batches(folder, every=2, bucket_rows=10), batches(2, 4)
    for n, rows in enumerate(parts):
        run(spark.createDataFrame(rows, RAW), n)
    want = rows_of(store.snapshot(spark, folder, 3))
    for n in (2, 3):  # the stream begins again before batch 2
        run(spark.createDataFrame(parts[n], RAW), n)
        assert rows_of(store.snapshot(spark, folder, 3)) == want
    os.remove(f"{folder}/manifest-3.json")  # a compaction that ended before its manifest
    assert rows_of(store.snapshot(spark, folder, 3)) == want
    run(spark.createDataFrame(parts[3], RAW), 3)
    assert rows_of(store.snapshot(spark, folder, 3)) == want and os.path.exists(f"{folder}/manifest-3.json")
    os.remove(f"{folder}/batch=3/_SUCCESS") if os.path.exists(f"{folder}/batch=3/_SUCCESS") else None
    assert rows_of(store.snapshot(spark, folder, 3)) == want  # the base has it


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    run = store.upsert_batches(folder, buckets=16)
    run(spark.range(20_000).select(F.lit("s").alias("source"), F.lit("sale").alias("deal_type"), F.col("id").cast("string").alias("external_id"), F.lit(1.0).alias("price_value"), F.lit(1).alias("collected_at")), 0)
    run(spark.createDataFrame([("s", "sale", str(k), 2.0, 2) for k in range(300)], RAW), 1)
    assert spark.read.parquet(f"{folder}/batch=1").count() == 300
    got = store.snapshot(spark, folder, 1)
    assert got.count() == 20_000 and got.where("price_value = 2.0").count() == 300
    store.compact(spark, folder, 1, 16)
    run(spark.createDataFrame([("s", "sale", "7", 3.0, 3)], RAW), 2)
    before = store.manifest(spark, folder, 2)
    store.compact(spark, folder, 2, 16)
    after = store.manifest(spark, folder, 2)
    assert sum(after.buckets[b] != p for b, p in before.buckets.items()) == 1  # one bucket is rewritten
    assert store.snapshot(spark, folder, 2).where("price_value = 3.0").count() == 1
