"""Distances on the spheroid against Vincenty's iteration; the report store's point lookup."""

import math
import random

import pytest
from pyspark.sql import functions as F

from listinglab.functions import geo
from listinglab.operators import dedupe, enrich
from listinglab.sources import io


def vincenty(y1, x1, y2, x2, a=6378137.0, f=1 / 298.257223563):
    b, d = (1 - f) * a, math.radians(x2 - x1)
    u, v = (math.atan((1 - f) * math.tan(math.radians(y))) for y in (y1, y2))
    if (y1, x1) == (y2, x2):
        return 0.0
    lam = d
    for _ in range(200):
        sin_s = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        cos_s = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u) * math.cos(v) * math.sin(lam) / sin_s
        cos2 = 1 - sin_a**2
        m = cos_s - 2 * math.sin(u) * math.sin(v) / cos2 if cos2 else 0.0
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        lam, old = d + (1 - c) * f * sin_a * (s + c * sin_s * (m + c * cos_s * (2 * m * m - 1))), lam
        if abs(lam - old) < 1e-13:
            break
    k = cos2 * (a * a - b * b) / (b * b)
    p = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    q = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    return b * p * (s - q * sin_s * (m + q / 4 * (cos_s * (2 * m * m - 1) - q / 6 * m * (4 * sin_s**2 - 3) * (4 * m * m - 3))))


def test_spheroid_distances(spark):
    rnd = random.Random(2)
    rows = [(55.7190196, 37.4788686, 55.7558, 37.6173), (0.0, 0.0, 0.0, 0.05), (0.0, 0.0, 0.05, 0.0), (60.0, 179.99, 60.0, -179.99), (55.0, 37.0, 55.0, 37.0), (89.9, 0.0, 89.9, 90.0)]
    for _ in range(200):
        y, x = rnd.uniform(-85, 85), rnd.uniform(-179, 179)
        rows.append((y, x, y + rnd.uniform(-0.06, 0.06), x + rnd.uniform(-0.06, 0.06)))
    far = [(rnd.uniform(-60, 60), rnd.uniform(-90, 0), rnd.uniform(-60, 60), rnd.uniform(0, 60)) for _ in range(50)]
    df = spark.createDataFrame(rows + far + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r["m"] for r in df.select(geo.spheroid_m((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("m")).collect()]
    assert got[-1] is None
    for row, m in zip(rows, got, strict=False):
        assert m == pytest.approx(vincenty(*row), abs=1.0)
    for row, m in zip(far, got[len(rows) :], strict=False):
        assert m == pytest.approx(vincenty(*row), rel=1e-4)


def test_joins_on_the_spheroid(spark):
    rnd = random.Random(5)
    rows = [(i, "m", "sale", 55 + rnd.uniform(0, 0.01), 37 + rnd.uniform(0, 0.02), 1, 100.0, 30.0, 1, 2000, "x", True) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, city string, deal_type string, lat double, lon double, rooms int, price_rub double, area_total double, floor int, year_built int, house_material string, is_active boolean")
    got = sorted((r["l_id"], r["r_id"]) for r in dedupe.candidate_pairs(df, radius_m=300.0, metres=geo.spheroid_m).collect())
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and vincenty(a[3], a[4], b[3], b[4]) <= 300]
    near = {r["id"]: r["density"] for r in enrich.neighbour_density(df, 500.0, geo.spheroid_m).collect()}
    assert near == {a[0]: sum(vincenty(a[3], a[4], b[3], b[4]) <= 500 for b in rows) - 1 for a in rows}


def test_a_report_is_read_from_its_shard(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), "id")).alias("id"), F.concat(F.lit("body "), "id").alias("raw_report"))
    store = io.save_reports(rows, path)
    files = len(store.inputFiles())
    assert files > 200 and store.count() == 3000
    one = io.get_report(store, "r42")
    assert [tuple(r) for r in one.select("id", "raw_report").collect()] == [("r42", "body 42")]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() <= 4 < files
    assert io.get_report(store, "none").count() == 0
    ids = {r["id"] for r in store.collect()}
    again = io.save_reports(rows, str(tmp_path / "again"))
    assert ids == {r["id"] for r in again.collect()} and len(ids) == 3000
