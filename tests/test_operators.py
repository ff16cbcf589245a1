"""Properties of joins, merges, components, models and streams."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listinglab.functions import geo
from listinglab.operators import clean, comps, enrich, features, geocode, history, merge, pages, reports, stats
from listinglab.operators.components import connected_components
from listinglab.plans import star
from listinglab.sources import io
from listinglab.streaming import streams

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def metres(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    s = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * math.asin(min(1, math.sqrt(s))) * geo.EARTH_M


@SLOW
@given(st.integers(0, 10**6), st.floats(20, 900))
def test_range_join_equals_brute_force(spark, seed, radius):
    rnd = random.Random(seed)
    pts = [(i, 55 + rnd.random() * 0.03, 37 + rnd.random() * 0.03) if i % 9 else (i, None, 37.0) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = geo.range_join(geo.prefixed(df, "l"), geo.prefixed(df, "r"), radius, []).select("l_id", "r_id").collect()
    want = {(a[0], b[0]) for a in pts for b in pts if a[1] and b[1] and metres(a[1:], b[1:]) <= radius}
    assert sorted(map(tuple, got)) == sorted(want)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components_are_reachability(spark, links):
    df = spark.createDataFrame(links, "a int, b int")
    root = {r["node"]: r["root"] for r in connected_components(df).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert root[n] == min(seen)
    assert root.keys() == near.keys()


def test_merge_is_idempotent_and_keeps_first_seen(spark):
    old = spark.createDataFrame([("a", 1, None, 1), ("b", 2, 5, 1), ("z", 9, 9, 1)], "k string, id int, price int, seen int")
    new = spark.createDataFrame([("a", 7, 3, 2), ("b", 7, 5, 2), ("c", 7, None, 2)], "k string, id int, price int, seen int")
    first = merge.merge_upsert(old, new, ["k"], ["price"], ["id"], ["seen"])
    got = {r["k"]: (r["id"], r["price"], r["seen"], r["action"]) for r in first.collect()}
    assert got == {"a": (1, 3, 2, "updated"), "b": (2, 5, 1, "unchanged"), "c": (7, None, 2, "inserted"), "z": (9, 9, 1, "kept")}
    again = merge.merge_upsert(first.drop("action"), new, ["k"], ["price"], ["id"], ["seen"])
    assert {r["action"] for r in again.where("k <> 'z'").collect()} == {"unchanged"}
    touched = merge.merge_upsert(old, new, ["k"], ["price"], ["id"], ["seen"], touch_unchanged=True)
    assert {r["k"]: r["seen"] for r in touched.collect()}["b"] == 2


def test_price_changes_log_no_nulls(spark):
    rows = [(1, 1, 1, None), (1, 2, 1, 5.0), (1, 3, 1, 5.0), (1, 4, 1, None), (1, 5, 1, 5.0), (2, 1, 1, 7.0)]
    df = spark.createDataFrame(rows, "listing_id int, ts int, seq int, price_rub double")
    assert sorted((r["listing_id"], r["ts"]) for r in history.price_changes(df).collect()) == [(1, 2), (1, 5), (2, 1)]


def test_floor_rule_needs_price_and_area(spark):
    base = star.view(spark, "/root/testdata/sf0.001", "listing_raw").limit(1).drop("price_value", "area_total", "floor", "floors_total", "rooms", "year_built")
    rows = spark.createDataFrame([(1.0, 10.0, 9, 5), (None, 10.0, 9, 5), (1.0, 0.0, 9, 5), (1.0, 10.0, 5, 5)], "price_value double, area_total double, floor int, floors_total int")
    got = clean.normalize(base.crossJoin(rows).withColumns({"rooms": F.lit(0), "year_built": F.lit(2000)})).collect()
    assert sorted((r["price_rub"] is None, r["area_total"], r["floor"]) for r in got) == [(False, 0.0, 9), (False, 10.0, 5), (True, 10.0, 9)]


def test_split_parts_known_times(spark, data):
    rows = star.view(spark, data, "listing_raw").withColumn("t", F.when(F.col("id") % 5 > 0, F.col("collected_at")))
    a, b = features.time_split(rows, "t", ratio=0.3)
    assert a.count() + b.count() == rows.where("t is not null").count()
    assert a.agg(F.max("t")).first()[0] < b.agg(F.min("t")).first()[0]
    with pytest.raises(ValueError):
        features.time_split(rows, "t", ratio=1.0)


def test_comparables_order(spark):
    t = spark.createDataFrame([(1, "m", 55.0, 37.0, 3, 90.0)], "request_id int, city string, lat double, lon double, rooms int, area_total double")
    near = [(0.0061, 90.0), (0.0061, 83.0), (0.4870, 60.0), (0.4887, 42.0), (1.1288, 95.0)]
    pool = [(i, "m", 55.0 + km / geo.EARTH_KM * 180 / math.pi, 37.0, 3, area, "rent_long", 1000.0, "u") for i, (km, area) in enumerate(near)]
    listing = spark.createDataFrame(pool, "id int, city string, lat double, lon double, rooms int, area_total double, deal_type string, price_rub double, url string")
    got = comps.comparables(t, listing).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4]
    assert [round(r["score"], 3) for r in got] == [0.006, 0.013, 0.651, 1.070, 1.132]


LD = '<script type="application/ld+json">{}</script>'


def ld(*blocks):
    return "".join(LD.format(b) for b in blocks)


def test_best_structured_block(spark):
    rows = [
        (1, ld('{"@type":"Organization","name":"X"}')),
        (2, ld('{"@type":"BreadcrumbList"}')),
        (3, ld('[{"@type":"Offer"},{"@type":"Product","offers":{"price":"5"}}]')),
        (4, "<p>none</p>"),
        (5, ld("{broken", '{"@type":"Offer","name":"y"}')),
    ]
    df = spark.createDataFrame(rows, "page_id int, html string")
    got = {r["page_id"]: r["t"] for r in df.select("page_id", pages.best_candidate(pages.structured(F.col("html")))["@type"].alias("t")).collect()}
    assert got == {1: "Organization", 2: None, 3: "Product", 4: None, 5: "Offer"}


def test_extract_listing(spark):
    html = ld('{"@type":"Product","name":"2-комнатная квартира, 54,3 м²","description":"на 5 этаже из 9, цена в месяц","offers":{"price":"70 000","priceCurrency":"RUR"}}') + (
        '<title>T</title><div data-latitude="55.7" data-longtitude="37.6"></div><span class="MetroWithTime">Сокол • 8 мин.</span>'
        '<div class="OfferCardFeature__text">дом 1999 года, кирпичный</div><div class="CardLocation__addressItem--x">Тверская, 1, </div>'
        '<div class="x__value">10,5 м²</div><div class="x__label">жилая</div>'
    )
    df = spark.createDataFrame([(1, "https://x.y/offer/123456789/", html), (2, None, None)], "page_id int, url string, html string")
    (r,) = pages.extract_listings(df).collect()
    assert (r["external_id"], r["rooms"], r["area_total"], r["floor"], r["floors_total"], r["price_value"], r["price_currency"], r["price_period"]) == ("123456789", 2, 54.3, 5, 9, 70000.0, "RUB", "month")
    assert (r["lat"], r["lon"], r["year_built"], r["house_material"], r["address_text"], r["metro"], r["area_living"]) == (55.7, 37.6, 1999, "кирпичный", "Тверская, 1", "Сокол • 8 мин.", 10.5)


def test_extract_listing_without_block_and_with_locality(spark):
    bare = (
        "<title>Квартира — Арбат, 10 — id 77</title><h1>3-комнатная квартира</h1><p data-latitude='1'></p><p data-latitude='55.1' data-longitude='37.2'></p>"
        '<div class="XMetroWithTime">no</div><div class="big MetroWithTime"><div>Арбатская</div> <div>• 4 мин.</div></div>'
        '<div class="OfferCardFeature__text">1936 м²</div><a class="OfferCardFeature__text z">панельный дом, сдан в 1985</a>'
    )
    said = ld('{"@type":"Offer","name":"x","address":{"streetAddress":"Арбат, 1","addressLocality":"Москва"}}')
    inline = "a" * 2500 + '{"point":{"latitude":1.5,"longitude":2.5}}' + "b" * 2100 + '"streetAddress":"Лесная, 7"' + "c" * 2900 + '{"point":{"latitude":55.5,"longitude":37.5}}'
    far = '"streetAddress":"Лесная, 7"' + "c" * 3100 + '{"point":{"latitude":55.5,"longitude":37.5}}'
    rows = [(1, "https://x.y/offer/111111/", bare), (2, "https://x.y/list", said), (3, "https://x.y/list", bare), (4, "https://x.y/offer/444444", inline), (5, "https://x.y/offer/555555?a", far)]
    got = {r["page_id"]: r for r in pages.extract_listings(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got.keys() == {1, 2, 4, 5}
    assert (got[1]["address_text"], got[1]["lat"], got[1]["lon"], got[1]["rooms"], got[1]["year_built"], got[1]["house_material"]) == ("Арбат, 10", 55.1, 37.2, 3, 1985, "панельный")
    assert got[1]["metro"].split() == ["Арбатская", "•", "4", "мин."] and got[1]["title"] == ""
    assert got[2]["address_text"] == "Арбат, 1, Москва"
    assert (got[4]["address_text"], got[4]["lat"], got[4]["lon"]) == ("Лесная, 7", 55.5, 37.5)
    assert (got[5]["lat"], got[5]["lon"]) == (None, None)


def test_stations_import(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('station,latitude,lng,city\nA,"55,5",37.1,M\nA,55.6,37.2,M\n,1,2,M\nB,x,2,M\nC,1,2,\n', encoding="utf-8")
    good, bad, summary = io.read_stations(spark, str(p))
    assert [tuple(r) for r in good.select("city", "name", "lat", "lon").collect()] == [("M", "A", 55.6, 37.2)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad coordinates", "empty name", "no city"]
    assert tuple(summary.first()) == (5, 1, 0, 3)
    assert io.read_stations(spark, str(p), dry_run=True)[0] is None


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "б")], "id int, t string")
    for kind in ("parquet", "csv"):
        io.write_table(df, f"{tmp_path}/x.{kind}")
        assert sorted(map(tuple, io.read_table(spark, f"{tmp_path}/x.{kind}").collect())) == [(1, "a"), (2, "б")]
    (tmp_path / "l.json").write_text('{"id":1}\n{"id":2}\n')
    (tmp_path / "a.json").write_text('[\n{"id":1},\n{"id":2}\n]')
    assert io.read_table(spark, f"{tmp_path}/l.json").count() == io.read_table(spark, f"{tmp_path}/a.json").count() == 2
    with pytest.raises(ValueError):
        io.read_table(spark, "x.xlsx")
    assert io.copy_table(df, f"{tmp_path}/copy") == 2
    store = io.save_reports(spark.createDataFrame([(None, "r"), ("k", "s")], "id string, raw_report string"), f"{tmp_path}/store")
    assert io.get_report(store, "k").count() == 1 and io.get_report(store, "none").count() == 0
    assert store.where("id is null").count() == 0


def test_stored_answers(spark):
    body = '[{"lat":"1","lon":"2","address":{"town":"Old Kazan"}},{"lat":"x","lon":"2"},{"lat":"3","lon":"4","address":{"city":"Perm"}}]'
    got = geocode.parsed_answers(spark.createDataFrame([(1, "Kazan", body)], "request_id int, city string, body string"))
    cities = spark.createDataFrame([("Perm", 0.0, 0.0)], "city string, center_lat double, center_lon double")
    assert [tuple(r) for r in geocode.pick_candidate(got, cities).collect()] == [(1, 0, 1.0, 2.0)]


def test_price_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2020-01-{1 + i:02d}", i, float(i // 4) if i % 5 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "listing_id long, ts string, seq long, price_rub double").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.where("seq < 10").coalesce(1).write.parquet(src)
    df.where("seq >= 10").coalesce(1).write.mode("append").parquet(src)
    out = streams.price_log(spark.readStream.schema(df.schema).parquet(src))
    q = out.writeStream.format("memory").queryName("price_log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["listing_id"], r["seq"]) for r in spark.table("price_log").collect())
    assert got == sorted((r["listing_id"], r["seq"]) for r in history.price_changes(df).collect())


def test_upsert_stream_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame([("s", "sale", "1", 5.0, 1), ("s", "sale", "2", 6.0, 1), ("s", "sale", "1", None, 2)], "source string, deal_type string, external_id string, price_value double, collected_at int")
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    raw.coalesce(1).write.parquet(src)
    q = spark.readStream.schema(raw.schema).parquet(src).writeStream.foreachBatch(streams.upsert_batches(store)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = streams.snapshot(spark, store, 99)
    assert sorted((r["external_id"], r["price_value"]) for r in got.collect()) == [("1", None), ("2", 6.0)]
    streams.upsert_batches(store)(raw, 0)  # a replay
    assert streams.snapshot(spark, store, 0).count() == 2


def test_ageing_stream(spark, tmp_path):
    rows = [(1, "sale", "2020-01-01"), (2, "rent_daily", "2020-01-01"), (3, "rent_long", "2020-10-01")]
    later = [(4, "sale", "2021-03-01"), (5, "sale", "2021-06-01")]
    schema, src = "id long, deal_type string, last_seen timestamp", str(tmp_path / "in")
    for part in (rows, later, later):
        df = spark.createDataFrame(part, "id long, deal_type string, s string").selectExpr("id", "deal_type", "cast(s as timestamp) as last_seen")
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.aged_out(stream).writeStream.format("memory").queryName("aged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["id"] for r in spark.table("aged").collect()] == [1]


def test_range_join_near_poles_and_antimeridian(spark):
    pts = [(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 89.9999, 0.0), (4, 89.9999, 180.0), (5, -89.99, 10.0), (6, -89.99, -170.0), (7, 75.0, 20.0), (8, 75.0, 20.015), (9, 75.0, 20.05), (10, 0.0, 0.0), (11, -0.001, -0.001)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    for radius in (500, 5000, 2_000_000):
        got = geo.range_join(geo.prefixed(df, "l"), geo.prefixed(df, "r"), radius, []).select("l_id", "r_id").collect()
        assert sorted(map(tuple, got)) == sorted((a[0], b[0]) for a in pts for b in pts if metres(a[1:], b[1:]) <= radius)


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), max_size=40))
def test_quantiles_equal_numpy(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = stats.quantiles(df, {"a": F.col("v"), "b": -F.col("v")}, [0.0, 0.1, 0.5, 0.9, 1.0])
    known = [v for v in values if v is not None]
    for name, xs in (("a", known), ("b", [-v for v in known])):
        assert got[name] == ([None] * 5 if not xs else pytest.approx(np.quantile(xs, [0.0, 0.1, 0.5, 0.9, 1.0]), abs=1e-6))


def test_densities_count_rows_of_one_place(spark):
    pts = [(i, "M", 55.0, 37.0 + (i // 50) * 0.001, i % 3 > 0) for i in range(200)] + [(900, "M", None, 37.0, True), (901, "M", 56.0, 37.0, False)]
    df = spark.createDataFrame(pts, "id int, city string, lat double, lon double, is_active boolean")
    got = {r["id"]: r["density"] for r in enrich.neighbour_density(df).collect()}
    want = {a[0]: sum(1 for b in pts if b[4] and b[2] and metres(a[2:4], b[2:4]) <= 500) - 1 for a in pts if a[2]}
    assert got == {k: v for k, v in want.items() if v >= 0}
    all_ = {r["id"]: r["density"] for r in enrich.density(df, df).collect()}
    assert all_[900] == 0 and all_[0] == 200 and all_[901] == 1


def test_training_columns_and_stations_fallback(spark):
    df = spark.createDataFrame([(1, "x", "u", "month", 5, 1.5, True, "p", None, 1.0)], "id int, external_id string, url string, price_period string, rooms int, area_total double, is_active boolean, geom string, contact_phone_hash string, price_rub double")
    assert clean.training_columns(df) == (["rooms", "area_total"], ["external_id", "price_period"])
    st_ = spark.createDataFrame([("A", "s", 55.0, 37.0)], "city string, name string, lat double, lon double")
    rows = spark.createDataFrame([(1, "A", 55.0, 37.001, True, "own"), (2, "B", 55.0, 37.001, True, None), (3, "A", 55.0, 37.001, True, None)], "id int, city string, lat double, lon double, is_active boolean, metro_station string")
    centres = spark.createDataFrame([("A", 55.0, 37.0)], "city string, center_lat double, center_lon double")
    got = {r["id"]: r for r in enrich.enrich(rows, st_, centres, "A").collect()}
    assert (got[1]["metro_station"], got[3]["metro_station"], got[2]["dist_to_metro_m"], got[2]["density_500m"]) == ("own", "s", None, None)
    assert got[1]["density_500m"] == 1 and got[1]["dist_to_metro_m"] == got[3]["dist_to_metro_m"] > 60
    far = {r["id"]: r for r in enrich.enrich(rows, st_, centres, "B").collect()}  # B has no stations: all are filled
    assert far[1]["density_500m"] == 2 and far[2]["dist_to_center_km"] is None and far[2]["density_500m"] == 2


def test_building_cache_precedence_and_age(spark):
    rows = spark.createDataFrame([(1, "M", "Дом  1", 55.0, 37.0, 0, None, ""), (2, "M", "дом 2", 55.0, 37.0, 7, 1990, "k"), (3, "M", "дом 3", 55.0, 37.0, None, None, None), (4, "M", "дом 4", 50.0, 37.0, None, None, None)], "id int, city string, address_norm string, lat double, lon double, floors_total int, year_built int, house_material string")
    built = spark.createDataFrame([(9, 55.0, 37.0, 5, 2001, "brick")], "building_id int, lat double, lon double, floors_total int, year_built int, house_material string")
    cache = spark.createDataFrame([("M", "дом 1", 3, None, None, "2000-12-01"), ("M", "дом 1", 4, 1955, None, "2000-12-31"), ("M", "дом 3", 8, 1960, "c", "1990-01-01")], "city string, address_norm string, floors_total int, year_built int, house_material string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    out, new = geocode.fill_building(rows, built, cache, as_of=F.lit("2001-01-10").cast("timestamp"), max_age_days=365)
    got = {r["id"]: (r["floors_total"], r["year_built"], r["house_material"]) for r in out.collect()}
    assert got == {1: (4, 1955, "brick"), 2: (7, 1990, "k"), 3: (5, 2001, "brick"), 4: (None, None, None)}
    assert out.columns == rows.columns
    assert sorted((r["address_norm"], r["floors_total"]) for r in new.collect()) == [("дом 1", 5), ("дом 3", 5)]


def test_tables_go_to_and_from_a_database(spark):
    url, driver = "jdbc:derby:memory:copies;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, f"t{i}", None if i % 3 else i / 2) for i in range(20)], "id int, t string, x double")
    assert io.copy_table(df, url=url, table="copies", driver=driver) == 20
    back = io.read_jdbc(spark, url, "copies", "id", 0, 20, 4, driver=driver)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="path"):
        io.copy_table(df)


def test_overrides_and_rejects_of_requests(spark):
    requests = spark.createDataFrame([(1, "M", "дом 1", None, None, 2, 50.0), (2, "M", "дом 2", 55.0, 37.0, None, 40.0), (3, "M", " ", None, None, 1, 30.0), (4, "M", "дом 4", None, None, 1, 30.0), (5, "M", "дом 5", 55.0, 37.0, 1, None)], "request_id int, city string, address string, lat double, lon double, rooms int, area_total double")
    cache = spark.createDataFrame([("M", "дом 1", 55.5, 37.5, "2001-01-01")], "city string, address_norm string, lat double, lon double, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    built = spark.createDataFrame([], "building_id int, lat double, lon double, floors_total int, year_built int, house_material string")
    other = spark.createDataFrame([(2, 3, None)], "request_id int, rooms int, area_total double")
    out, new = reports.resolve_requests(requests, cache, built, other)
    got = {r["request_id"]: (r["reject"], r["rooms"], r["area_total"], r["lat"]) for r in out.collect()}
    assert got == {1: (None, 2, 50.0, 55.5), 2: (None, 3, 40.0, 55.0), 3: ("address", 1, 30.0, None), 4: ("not found", 1, 30.0, None), 5: ("area_total", 1, None, 55.0)}
    assert new.count() == 0


def test_upsert_stream_touches_only_its_buckets(spark, tmp_path):
    import os

    row = lambda key, price, at: ("s", "sale", key, price, at)
    batches = [[row(str(i), 1.0, 1) for i in range(30)], [row("3", 2.0, 2)], [row("3", 3.0, 3), row("x", 9.0, 3)]]
    schema, run = "source string, deal_type string, external_id string, price_value double, collected_at int", streams.upsert_batches(str(tmp_path), buckets=8)
    for n, rows in enumerate(batches):
        run(spark.createDataFrame(rows, schema), n)
    assert len([x for x in os.listdir(tmp_path / "batch=1") if x.startswith("bucket=")]) == 1
    want = {str(i): 1.0 for i in range(30)} | {"3": 3.0, "x": 9.0}
    assert {r["external_id"]: r["price_value"] for r in streams.snapshot(spark, str(tmp_path), 2).collect()} == want
    run(spark.createDataFrame(batches[2], schema), 2)  # a replay
    assert {r["external_id"]: r["price_value"] for r in streams.snapshot(spark, str(tmp_path), 9).collect()} == want
