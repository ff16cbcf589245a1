"""The nearest-neighbour join against brute force: ties, empty keys, sparse corners, poles."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from listinglab.functions import geo
from listinglab.operators import comps, enrich

SQL_POINT = "id long, city string, lat double, lon double"


def metres(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    return 2 * math.asin(min(1, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))) * geo.EARTH_M


@pytest.mark.parametrize("few", [0, 1000])
def test_nearest_station_equals_brute_force(spark, few):
    rnd = random.Random(1)
    near = lambda: (55 + rnd.gauss(0, 0.05), 37 + rnd.gauss(0, 0.08))
    far = lambda: (rnd.uniform(-89, 89), rnd.uniform(-180, 180))
    stations = [(f"s{i}", "m", *near()) for i in range(150)] + [(f"t{i}", "m", *near()) for i in range(3)] + [(f"e{i}", "earth", *far()) for i in range(30)] + [("b", "tie", 10.0, 10.0), ("a", "tie", 10.0, 10.0), ("none", "gone", None, 1.0), ("x", None, 1.0, 1.0)]
    points = [("m", *near()) for _ in range(200)] + [("m", *far()) for _ in range(20)] + [("earth", *far()) for _ in range(60)] + [("earth", 89.99, 10.0), ("earth", 0.0, 179.999), ("tie", 10.001, 10.0), ("gone", 1.0, 1.0), ("empty", 1.0, 1.0), (None, 1.0, 1.0), ("m", None, 1.0)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], SQL_POINT)
    s = spark.createDataFrame(stations, "name string, city string, lat double, lon double")
    got = {r["id"]: (round(r["dist_m"], 3), r["station"]) for r in enrich.nearest_station(p, s, few=few).collect()}
    want = {}
    for i, (city, *at) in enumerate(points):
        own = [(metres(at, q), n) for n, c, *q in stations if c == city and city and None not in (*q, *at)]
        if own:
            d, n = min(own)
            want[i] = (round(d, 3), n)
    assert got == want


@pytest.mark.parametrize("seed, few", [(1, 0), (2, 0), (3, 1000)])
def test_comparables_equal_brute_force(spark, seed, few):
    rnd = random.Random(seed)
    house = (55.7, 37.6)
    spot = lambda: house if rnd.random() < 0.4 else (55.7 + rnd.gauss(0, 0.02), 37.6 + rnd.gauss(0, 0.02))
    area = lambda: rnd.choice([30.0, 31.0, 45.5, 60.0, 200.0, 9.0, 0.0, rnd.uniform(20, 90)])
    pool = [(i, rnd.choice("mmmk"), *spot(), rnd.choice([None, 0, 1, 2, 3]), area(), "rent_long", 1.0) for i in range(600)] + [(900, "m", None, 1.0, 1, 30.0, "rent_long", 1.0)]
    targets = [(i, rnd.choice("mk"), *spot(), rnd.choice([None, 0, 1, 2, 7]), rnd.choice([area(), None, -1.0])) for i in range(60)] + [(99, "m", 50.0, 30.0, 1, 30.0), (98, "none", *house, 1, 30.0), (97, "m", None, 1.0, 1, 30.0)]
    t = spark.createDataFrame(targets, "request_id long, city string, lat double, lon double, rooms int, area_total double")
    p = spark.createDataFrame(pool, "id long, city string, lat double, lon double, rooms int, area_total double, deal_type string, price_rub double")
    bucket = lambda r: "other" if r is None else "studio" if r <= 0 else f"r{r}" if r <= 4 else "r5p"
    want = {}
    for i, city, y, x, rooms, a in targets:
        rows = []
        for j, c, v, u, r, b, *_ in pool:
            if c == city and None not in (y, x, v, u) and (km := metres((y, x), (v, u)) / geo.EARTH_M * geo.EARTH_KM) <= 3.0:
                rows.append((bucket(r) == bucket(rooms), km + (math.log(min(max(b / a, 0.2), 5.0)) ** 2 if a and a > 0 else 0.0), j))
        rows = [x for x in rows if x[0]] or rows
        for n, (_, s, j) in enumerate(sorted(rows, key=lambda x: (round(x[1], 12), x[2]))[:5], 1):
            want[i, n] = (j, round(s, 6))
    got = {(r["request_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in comps.comparables(t, p, few=few).collect()}
    assert got == want


def test_rows_met_do_not_grow_with_the_city(spark):
    """Ten times the stations, and the same number of pairs for each point."""
    points = spark.range(2000).select("id", F.lit("m").alias("city"), (55 + F.rand(1) * 0.4).alias("lat"), (37 + F.rand(2) * 0.7).alias("lon"))
    met = []
    for n in (400, 4000):
        s = spark.range(n).select(F.concat(F.lit("s"), "id").alias("name"), F.lit("m").alias("city"), (55 + F.rand(3) * 0.4).alias("lat"), (37 + F.rand(4) * 0.7).alias("lon"))
        met.append(enrich.station_search(points, s.repartition(2)).candidates().count() / 2000)
    print("stations met by a point of a city of 400, 4000:", met)
    assert max(met) < 4


def test_a_dense_house_is_no_all_pairs(spark):
    """A house of many listings with equal areas: only the k least ids of equal ones are met."""
    p = spark.range(20_000).select("id", F.lit("m").alias("city"), F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"), F.lit("r1").alias("bucket"), (30 + F.col("id") % 40).cast("double").alias("area_total"))
    t = spark.range(50).select("id", F.lit("m").alias("city"), F.lit(55.0).alias("lat"), F.lit(37.0).alias("lon"), F.lit("r1").alias("bucket"), F.lit(40.0).alias("area_total"))
    met = comps.search(geo.prefixed(t, "l"), geo.prefixed(p, "r"), 5, 3.0, ["city", "bucket"]).candidates().count()
    assert met == 50 * 5


def test_a_row_looks_only_as_far_as_its_bound(spark, monkeypatch):
    """Even listings and targets: the cells that are shuffled hold each listing once a width, and a
    target looks into those that its bound reaches, not into all 27 around it. Nothing is lost,
    with a radius below the width of a band of area either."""
    p = [(i, "m", "a", 55 + (i * 7919 % 10007) / 10007 * 0.05, 37 + (i * 104729 % 10009) / 10009 * 0.08, 20.0 + i % 97) for i in range(3000)]
    t = [(i, "m", "a", 55 + (i * 5003 % 10007) / 10007 * 0.05, 37 + (i * 3001 % 10009) / 10009 * 0.08, 20.0 + i % 89) for i in range(500)]
    shape = "id long, city string, bucket string, lat double, lon double, area_total double"
    left, right = geo.prefixed(spark.createDataFrame(t, shape), "l"), geo.prefixed(spark.createDataFrame(p, shape), "r")
    for radius in (3.0, 0.4):
        want = [(r["l_id"], r["rank"], r["r_id"]) for r in comps.search(left, right, 5, radius, ["city", "bucket"], few=10**9).best().collect()]
        met, seen = geo.Nearest._met, []
        monkeypatch.setattr(geo.Nearest, "_met", lambda self, looks, cells: seen.append((looks, cells)) or met(self, looks, cells))
        search = comps.search(left, right, 5, radius, ["city", "bucket"], few=0)
        search.lacking = False
        found = search.candidates()
        rows = [(looks.count(), cells.count()) for looks, cells in seen]
        monkeypatch.undo()
        assert rows[-1][0] < 16 * 500 and all(c <= 6 * 3000 for _, c in rows)
        ranked = sorted(((r["l_id"], r["score"], r["r_id"]) for r in found.select("l_id", "score", "r_id").collect()))
        got = [(l, n, r) for l, group in itertools.groupby(ranked, key=lambda x: x[0]) for n, (_, _, r) in enumerate(group, 1) if n <= 5]
        assert sorted(got) == sorted(want)
