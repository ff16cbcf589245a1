"""The price log of rows out of order: as in batch for all that come in time."""

import random

from pyspark.sql import functions as F

from listinglab.operators import history
from listinglab.streaming import streams

SCHEMA = "listing_id long, ts timestamp, seq long, price_rub double"


def test_rows_out_of_order_are_logged_in_order(spark, tmp_path):
    rnd = random.Random(3)
    day = 1_577_836_800  # 2020
    rows = [(k % 4, day + 3600 * k, k, rnd.choice([None, 1.0, 2.0])) for k in range(80)]
    sent = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 4 * 3600))  # within the delay of half a day
    late = [(1, day + 3600, 900, 77.0), (2, day + 7200, 901, None)]
    end = [(9, day + 3600 * 1000, 999, 1.0)]
    parts = [sent[k : k + 16] for k in range(0, 80, 16)] + [late, end, end]
    src = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, "listing_id long, t long, seq long, price_rub double").select("listing_id", F.timestamp_seconds("t").alias("ts"), "seq", "price_rub").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    log = streams.ordered_price_log(stream, delay_s=12 * 3600, grace_s=300 * 86_400)
    q = log.writeStream.format("memory").queryName("ordered_log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("ordered_log").select("listing_id", "seq", "price_rub", "late").collect()]
    assert sorted(r[1] for r in got if r[3]) == [900, 901]
    batch = spark.createDataFrame(rows, "listing_id long, t long, seq long, price_rub double").select("listing_id", F.timestamp_seconds("t").alias("ts"), "seq", "price_rub")
    want = sorted((r["listing_id"], r["seq"], r["price_rub"]) for r in history.price_changes(batch).collect())
    assert sorted(r[:3] for r in got if not r[3]) == want
