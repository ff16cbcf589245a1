"""Geographic enrichment of listings. Each step fills only what is null."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def _at(lat: str, lon: str) -> geo.Point:
    return F.col(lat), F.col(lon)


STATION_CELLS = geo.widening(500.0, 128_000.0)  # then the whole city


def station_search(points: DataFrame, stations: DataFrame, id_: str = "id", few: int = 100) -> geo.Nearest:
    """The search for each point's nearest station in its city, ties by name."""
    s = stations.select(F.col("name").alias("r_id"), F.col("city").alias("r_city"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    p = points.select(F.col(id_).alias("l_id"), F.col("city").alias("l_city"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    return geo.Nearest(p, s, 1, ["city"], geo.distance_m(_at("l_lat", "l_lon"), _at("r_lat", "r_lon")), STATION_CELLS, few=few)


def nearest_station(points: DataFrame, stations: DataFrame, id_: str = "id", few: int = 100) -> DataFrame:
    """(id, dist_m, station) of the nearest station of each point's city; ties by name.
    Cells around a point widen until they must hold it, so that a point meets few stations,
    however many its city has (cities of at most `few` are met whole). Points of a city without stations have no row."""
    found = station_search(points, stations, id_, few).best()
    return found.select(F.col("l_id").alias(id_), F.col("score").alias("dist_m"), F.col("r_id").alias("station"))


def stations_for(stations: DataFrame, city: str | None) -> tuple[DataFrame, bool]:
    """The stations of `city`, or all of them if it has none; and whether it has some."""
    if not city:
        return stations, False
    own = stations.where(F.col("city") == city)
    return (own, True) if own.take(1) else (stations, False)


def center_distance_km(points: DataFrame, cities: DataFrame) -> DataFrame:
    """`points` with center_km, the distance to its city's centre (null without one)."""
    c = cities.select("city", "center_lat", "center_lon")
    d = geo.distance_m(_at("lat", "lon"), _at("center_lat", "center_lon")) / 1000
    return points.join(c, "city", "left").withColumn("center_km", d).drop("center_lat", "center_lon")


def density(points: DataFrame, others: DataFrame, radius_m: float = 500.0, id_: str = "id", keys: list[str] | None = None, metres: geo.Metres = geo.distance_m) -> DataFrame:
    """(id, density) for every point: how many rows of `others` lie within the radius."""
    n = _counted_near(points, others, radius_m, keys or [], metres)
    at = ["lat", "lon", *(keys or [])]
    return points.select(id_, *at).join(n, at, "left").select(id_, F.coalesce("density", F.lit(0)).cast("long").alias("density"))


def _counted_near(points: DataFrame, others: DataFrame, radius_m: float, keys: list[str], metres: geo.Metres = geo.distance_m) -> DataFrame:
    """(lat, lon, keys, density) of the distinct places of `points`. Rows of one place are
    counted before the join, so a house with thousands of listings is one row on either side."""
    at = ["lat", "lon", *keys]
    left = geo.prefixed(points.select(*at).where(geo.has_point("lat", "lon")).distinct(), "l")
    right = geo.prefixed(others.groupBy(*at).agg(F.count("*").alias("n")), "r")
    return geo.range_join(left, right, radius_m, keys, metres=metres).groupBy(*[F.col(f"l_{c}").alias(c) for c in at]).agg(F.sum("r_n").alias("density"))


def neighbour_density(listing: DataFrame, radius_m: float = 500.0, metres: geo.Metres = geo.distance_m) -> DataFrame:
    """(id, density): active listings within the radius, less one. Inactive listings are
    less one too, though not among their own neighbours; listings with no neighbour at all
    have no row. metres: on the sphere, or `geo.spheroid_m`."""
    n = _counted_near(listing, listing.where("is_active"), radius_m, [], metres)
    return listing.select("id", "lat", "lon").join(n, ["lat", "lon"]).select("id", (F.col("density") - 1).alias("density"))


def recent(listing: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return listing.where("is_active").where(F.col("last_seen") >= as_of - F.expr(f"interval {days} days"))


def enrich(listing: DataFrame, stations: DataFrame, cities: DataFrame, city: str | None = None) -> DataFrame:
    """dist_to_metro_m, metro_station, dist_to_center_km and density_500m, where null. With
    a `city` only its listings are filled, by their neighbours in it; if it has no stations,
    all are (J5)."""
    stations, own = stations_for(stations, city)
    if own:
        mine = F.col("city") == city
        rest = listing.where(~F.coalesce(mine, F.lit(False)))
        return enrich(listing.where(mine), stations, cities).unionByName(rest, allowMissingColumns=True)
    for c, kind in (("dist_to_metro_m", "double"), ("metro_station", "string"), ("dist_to_center_km", "double"), ("density_500m", "long")):
        if c not in listing.columns:
            listing = listing.withColumn(c, F.lit(None).cast(kind))
    near = nearest_station(listing.where("dist_to_metro_m is null"), stations).withColumnsRenamed({"dist_m": "_m", "station": "_st"})
    n = _counted_near(listing.where("density_500m is null"), listing.where("is_active"), 500.0, [])
    dense = listing.where("density_500m is null").select("id", "lat", "lon").join(n, ["lat", "lon"]).select("id", (F.col("density") - 1).alias("_n"))
    out = center_distance_km(listing, cities).join(near, "id", "left").join(dense, "id", "left")
    return out.withColumns({"dist_to_metro_m": F.coalesce("dist_to_metro_m", "_m"), "metro_station": F.coalesce("metro_station", "_st"), "dist_to_center_km": F.coalesce("dist_to_center_km", "center_km"), "density_500m": F.coalesce("density_500m", "_n")}).drop("_m", "_st", "_n", "center_km")
