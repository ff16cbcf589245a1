"""Duplicate candidates by bands against all pairs, and a dense house."""

import math
import random

from pyspark.sql import functions as F

from listinglab.functions import geo
from listinglab.operators import dedupe

LISTING = "id long, city string, deal_type string, lat double, lon double, rooms int, price_rub double, area_total double, floor int, year_built int, house_material string, is_active boolean"


def metres(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    return 2 * math.asin(min(1, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))) * geo.EARTH_M


def test_candidates_equal_all_pairs(spark):
    rnd = random.Random(4)
    price = lambda: rnd.choice([None, 0.0, -5.0, 100.0, 95.0, 94.99, 105.0, 1000.0, 950.0, 1e-3, 1.0, 1.05, rnd.uniform(90, 110)])
    area = lambda: rnd.choice([None, 30.0, 32.0, 34.0, 28.0, 0.0, -1.0, 31.999, 30 + rnd.random() * 8])
    rows = [(i, rnd.choice(["m", "m", "k", None]), rnd.choice(["sale", "rent"]), 55.0 + rnd.choice([0, 0, 3e-4, 4.4e-4, 6e-4]), rnd.choice([37.0, 37.0, 37.0005, None]), rnd.choice([None, 0, 1, 1, 2]), price(), area(), 1, 2000, "x", rnd.random() < 0.9) for i in range(400)]
    got = sorted((r["l_id"], r["r_id"]) for r in dedupe.candidate_pairs(spark.createDataFrame(rows, LISTING)).select("l_id", "r_id").collect())
    want = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[11] and b[11] and a[1] and a[1:3] == b[1:3] and a[4] and b[4] and a[5] == b[5] and None not in (a[7], b[7]) and abs(a[7] - b[7]) <= 2 and metres(a[3:5], b[3:5]) <= 50:
                p, q = a[6], b[6]
                if p is None or q is None or (p > 0 and q > 0 and abs(p - q) / max(p, q) <= 0.05):
                    want.append((a[0], b[0]))
    assert got == want and len(want) > 100


def test_a_dense_house_meets_its_candidates_only(spark):
    """A hundred thousand mixed listings at one place: 5 * 10^9 pairs, of which few are alike."""
    rows = spark.range(100_000).select(
        "id", F.lit("m").alias("city"), F.lit("sale").alias("deal_type"), F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"), (F.col("id") % 5).cast("int").alias("rooms"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10_000.0).alias("price_rub"), (20 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 100.0).alias("area_total"),
        F.lit(1).alias("floor"), F.lit(2000).alias("year_built"), F.lit("x").alias("house_material"), F.lit(True).alias("is_active"),
    )
    n = dedupe.candidate_pairs(rows).count()
    # of one number of rooms are 20,000; 0.4 % of pairs are 2 m2 apart, 1 % five hundredths in price
    assert 0.5 * 40_000 < n < 2 * 40_000


def test_few_rows_are_shuffled_for_a_listing(spark, monkeypatch):
    """Scattered listings: about three rows that look and two that stand, not nine cells with
    every band in each; none is lost at the poles, at the antimeridian or without a price."""
    rnd = random.Random(5)
    here = lambda: rnd.choice([(55 + rnd.random() * 4e-3, 37 + rnd.random() * 4e-3), (rnd.choice([1, -1]) * (89.999 + rnd.random() * 1e-3), rnd.uniform(-180, 180)), (rnd.random() * 4e-3 - 2e-3, rnd.choice([-180, 180 - 2e-3]) + rnd.random() * 2e-3)])
    rows = [(i, "m", "sale", *here(), rnd.choice([None, 1]), rnd.choice([None, -1.0, *[rnd.uniform(80, 120)] * 18]), 30 + rnd.random() * 20, 1, 2000, "x", True) for i in range(1500)]
    joined, frame = [], type(spark.range(0))
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, *a, **b: joined.append((self, other)) or join(self, other, *a, **b))
    got = sorted((r["l_id"], r["r_id"]) for r in dedupe.candidate_pairs(spark.createDataFrame(rows, LISTING)).select("l_id", "r_id").collect())
    monkeypatch.undo()
    fits = lambda p, q: p is None or q is None or (p > 0 and q > 0 and abs(p - q) / max(p, q) <= 0.05)
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[5] == b[5] and abs(a[7] - b[7]) <= 2 and fits(a[6], b[6]) and metres(a[3:5], b[3:5]) <= 50]
    assert got == want and len(want) > 300
    assert sum(x.count() + y.count() for x, y in joined) < 6.5 * len(rows)
