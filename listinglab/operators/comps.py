"""Comparables: the listings most like a target nearby."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..sources.shared import dropped, stored

FOUND = ["l_id", "rank", "r_id", "l_lat", "l_lon", "r_lat", "r_lon", "score"]

# What is told of a comparable, as far as the listing has it.
FACTS = [
    "deal_type", "city", "district", "price_rub", "price_per_m2", "rooms", "area_total", "area_living", "area_kitchen",
    "floor", "floors_total", "year_built", "house_material", "condition", "lat", "lon", "dist_to_metro_m",
    "dist_to_center_km", "density_500m", "metro_station", "metro_walk_min", "address_norm", "url",
]

PENALTY_REACH = math.log(5.0)  # beyond a fifth or five times the area, the penalty is the same


def search(t: DataFrame, p: DataFrame, k: int, radius_km: float, keys: list[str], few: int = 1000) -> geo.Nearest:
    """The search among `p` for comparables of `t`, of columns l_ and r_: the score's distance
    and its difference in log area are both bounded by cells."""
    km = geo.haversine_km((F.col("l_lat"), F.col("l_lon")), (F.col("r_lat"), F.col("r_lon")))
    score = F.when(km <= radius_km, km + tx.area_penalty("r_area_total", "l_area_total"))
    log_area = lambda c: F.when(F.col(c) > 0, F.ln(c))
    t, p = t.withColumn("l_axis", log_area("l_area_total")), p.withColumn("r_axis", log_area("r_area_total"))
    return geo.Nearest(t, p, k, keys, score, geo.widening(4.0, radius_km * 1001), 1000.0, radius_km * 1000, PENALTY_REACH, few)


def comparables(targets: DataFrame, listing: DataFrame, k: int = 5, radius_km: float = 3.0, few: int = 1000) -> DataFrame:
    """Up to `k` long rents of a target's city within the radius, by kilometres plus the
    area penalty, ties by id: request_id, rank, id, distance_km, score and the listing's facts.
    Only those of the target's rooms bucket count if there are any (W4), else all. A target
    looks into cells of place and area around it that widen until they must hold its best, so it
    meets few listings, however many a town has (towns of at most `few` are met whole); facts
    are joined to the best."""
    t = geo.prefixed(targets.select(F.col("request_id").alias("id"), "city", "lat", "lon", tx.rooms_bucket("rooms").alias("bucket"), "area_total"), "l")
    pool = listing.where("deal_type = 'rent_long' and price_rub is not null and area_total is not null")
    p = stored(geo.prefixed(pool.select("id", "city", "lat", "lon", tx.rooms_bucket("rooms").alias("bucket"), "area_total"), "r"), "pool")  # each search reads it twice
    own = search(t, p, k, radius_km, ["city", "bucket"], few).best().select(*FOUND)
    alone = t.join(own.select("l_id").distinct(), "l_id", "left_anti")
    if alone.take(1):
        own = own.unionByName(search(alone, p, k, radius_km, ["city"], few).best().select(*FOUND))
    dropped(p)
    km = geo.haversine_km((F.col("l_lat"), F.col("l_lon")), (F.col("r_lat"), F.col("r_lon")))
    found = own.select(F.col("l_id").alias("request_id"), "rank", F.col("r_id").alias("id"), km.alias("distance_km"), "score")
    return found.join(pool.select("id", *[c for c in FACTS if c in pool.columns]), "id").select("request_id", "rank", "id", "distance_km", "score", *[c for c in FACTS if c in pool.columns])


def as_array(comps: DataFrame) -> DataFrame:
    """(request_id, comparables): each target's comparables in order, as an array of structs."""
    rest = [c for c in comps.columns if c not in ("request_id", "rank")]
    return comps.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("comparables"))
