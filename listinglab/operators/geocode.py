"""Geocoding from stored answers, and building facts from a building table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from .clean import fresh, without_point


def cached_points(cache: DataFrame, as_of: Column | None = None, max_age_days: float | None = None) -> DataFrame:
    """One valid cache row for each (city, address): the newest."""
    valid = cache if as_of is None else cache.where(fresh("created_at", as_of, max_age_days))
    best = F.max_by(F.struct("lat", "lon"), F.struct("created_at", "lat", "lon")).alias("_p")
    return valid.groupBy("city", "address_norm").agg(best).select("city", "address_norm", F.col("_p.lat").alias("_lat"), F.col("_p.lon").alias("_lon"))


def fill_points(rows: DataFrame, cache: DataFrame, address: Column, as_of: Column | None = None, max_age_days: float | None = None) -> DataFrame:
    """Own coordinates first, then the cache's, by city and canonical address; `geo_source`
    is own, cache or null."""
    hit = cached_points(cache, as_of, max_age_days).withColumnsRenamed({"city": "_city", "address_norm": "_addr"})
    keyed = rows.withColumn("_key", tx.canon_addr(address))
    met = keyed.join(hit, (F.col("city") == F.col("_city")) & (F.col("_key") == F.col("_addr")), "left")
    own = geo.has_point("lat", "lon")
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.coalesce(F.col(b), F.col(a)))
    source = F.when(own, "own").when(F.col("_lat").isNotNull() & F.col("_lon").isNotNull(), "cache")
    return met.withColumns({"geo_source": source, "lat": pick("lat", "_lat"), "lon": pick("lon", "_lon")}).drop("_city", "_addr", "_key", "_lat", "_lon")


def work_list(rows: DataFrame, default_city: str = "") -> DataFrame:
    """B5's misses (P9, F8, F9): what would have to be asked, each query once."""
    q = tx.geocode_query("address_norm", "city", default_city)
    return without_point(rows).select(q.alias("query"), tx.address_hash("address_norm").alias("address_hash")).distinct()


def geocode(listing: DataFrame, cache: DataFrame, default_city: str = "") -> tuple[DataFrame, DataFrame]:
    """(listings with points filled from the cache, queries still to be asked)."""
    filled = fill_points(listing, cache, F.col("address_norm"))
    return filled, work_list(filled, default_city)


def pick_candidate(candidates: DataFrame, cities: DataFrame) -> DataFrame:
    """One stored answer for each request (request_id, city, pos, cand_city, lat, lon):
    those that name the city first, then the nearest to its centre if that is known, then the
    earliest."""
    c = candidates.join(cities.select("city", "center_lat", "center_lon"), "city", "left")
    km = geo.haversine_km((F.col("center_lat"), F.col("center_lon")), (F.col("lat"), F.col("lon")))
    match = F.coalesce(F.contains(F.lower("cand_city"), F.lower("city")), F.lit(False))
    best = F.min_by(F.struct("pos", "lat", "lon"), F.struct(F.when(match, 0).otherwise(1), F.coalesce(F.round(km, 9), F.lit(0.0)), "pos"))
    return c.groupBy("request_id").agg(best.alias("_b")).select("request_id", "_b.pos", "_b.lat", "_b.lon")


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Candidates of stored JSON answers (request_id, city, body): (pos, cand_city, lat,
    lon); the city is the first named of city, town and state."""
    shape = "array<struct<lat: string, lon: string, address: struct<city: string, town: string, state: string>>>"
    rows = answers.select("request_id", "city", F.posexplode(F.from_json("body", shape)).alias("pos", "c"))
    named = F.coalesce(*[F.nullif(F.col(f"c.address.{k}"), F.lit("")) for k in ("city", "town", "state")], F.lit(""))
    return rows.select("request_id", "city", "pos", named.alias("cand_city"), F.col("c.lat").try_cast("double").alias("lat"), F.col("c.lon").try_cast("double").alias("lon")).where("lat is not null and lon is not null")


def building_near(rows: DataFrame, buildings: DataFrame, radius_m: float = 60.0, id_: str = "id") -> DataFrame:
    """(id, building_id and facts) of the nearest building in reach; ties by id."""
    facts = ["building_id", "floors_total", "year_built", "house_material"]
    met = geo.range_join(geo.prefixed(rows.select(id_, "lat", "lon"), "l"), geo.prefixed(buildings.select("lat", "lon", *facts), "r"), radius_m, [])
    best = F.min_by(F.struct(*[F.col(f"r_{f}").alias(f) for f in facts]), F.struct("dist_m", "r_building_id"))
    return met.groupBy(F.col(f"l_{id_}").alias(id_)).agg(best.alias("_b")).select(id_, "_b.*")


_BUILT = (("floors_total", 0), ("year_built", 0), ("house_material", ""))


def cached_buildings(cache: DataFrame, as_of: Column | None = None, max_age_days: float | None = 365) -> DataFrame:
    """The newest row of each (city, address_norm), if it is still valid (P10)."""
    facts = [c for c, _ in _BUILT]
    best = F.max_by(F.struct(*facts, "created_at"), F.struct("created_at", *facts)).alias("_b")
    newest = cache.groupBy("city", "address_norm").agg(best)
    valid = newest if as_of is None else newest.where(fresh(F.col("_b.created_at"), as_of, max_age_days))
    return valid.select("city", "address_norm", *[F.col(f"_b.{c}").alias(f"_c_{c}") for c in facts])


def fill_building(rows: DataFrame, buildings: DataFrame, cache: DataFrame | None = None, radius_m: float = 60.0, id_: str = "id", address: str = "address_norm", as_of: Column | None = None, max_age_days: float | None = 365) -> tuple[DataFrame, DataFrame]:
    """(rows with floors_total, year_built and house_material filled, new cache rows).

    A value is the row's own, else the cache's by city and canonical address (valid for
    `max_age_days`), else the nearest building's. 0 and empty count as missing on the way. Where
    a building had to be asked and was found, its facts are a new row for the cache, one for
    each (city, address); without `as_of` its time is null."""
    some = lambda c, empty: F.nullif(F.col(c), F.lit(empty))
    out = rows.withColumn("_addr", tx.canon_addr(address))
    if cache is not None:
        c = cached_buildings(cache, as_of, max_age_days).withColumnsRenamed({"city": "_city", "address_norm": "_key"})
        out = out.join(c, (F.trim("city") == F.col("_city")) & (F.col("_addr") == F.col("_key")), "left").drop("_city", "_key")
        out = out.withColumns({c: F.coalesce(some(c, e), some(f"_c_{c}", e)) for c, e in _BUILT}).drop(*[f"_c_{c}" for c, _ in _BUILT])
    else:
        out = out.withColumns({c: some(c, e) for c, e in _BUILT})
    lacking = F.col("floors_total").isNull() | F.col("year_built").isNull() | F.col("house_material").isNull()
    near = building_near(out.where(lacking), buildings, radius_m, id_).withColumnsRenamed({c: f"_b_{c}" for c, _ in _BUILT})
    met = out.join(near, id_, "left")
    new = met.where(F.col("building_id").isNotNull() & (F.col("_addr") != "") & F.col("city").isNotNull())
    best = F.min_by(F.struct("lat", "lon", *[F.col(f"_b_{c}").alias(c) for c, _ in _BUILT]), F.struct(F.col(id_))).alias("_n")
    new = new.groupBy(F.trim("city").alias("city"), F.col("_addr").alias("address_norm")).agg(best).select("city", "address_norm", "_n.*", (as_of if as_of is not None else F.lit(None).cast("timestamp")).alias("created_at"))
    filled = met.withColumns({c: F.coalesce(c, some(f"_b_{c}", e)) for c, e in _BUILT})
    return filled.drop("_addr", "building_id", *[f"_b_{c}" for c, _ in _BUILT]), new
