"""Queries over the driver's tables, one for each operator or job, and their DuckDB twins."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..operators import clean, comps, dedupe, enrich, features, geocode, history, merge, model, pages, reports, stats
from ..operators.components import connected_components
from ..sources import io
from ..sources.shared import shared_dir, stored
from . import star
from .pipeline import run_pipeline, training_tables, value_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TS = f"TIMESTAMP '{star.AS_OF}'"

# The normalised listing, as `clean.normalize` makes it of the view listing_raw. The station is
# what stands before the minutes, or else the text up to a comma without them.
_MT = r"TRIM(REGEXP_REPLACE(COALESCE(metro, ''), '\s+', ' ', 'g'))"
_MAIN = r"(?i)^\s*(.*?)\s*[•·,;\-]*\s*(\d{1,3})\s*мин\.?"
_HIT = f"REGEXP_MATCHES({_MT}, '{_MAIN}')"
_STATION = rf"""CASE WHEN {_HIT} THEN TRIM(REGEXP_REPLACE(REGEXP_EXTRACT({_MT}, '{_MAIN}', 1), '[ •·,;-]+$', ''), ' -—–')
  ELSE TRIM(REGEXP_REPLACE(SPLIT_PART(REGEXP_REPLACE({_MT}, '(?i)[•·,;\s-]*\d{{1,3}}\s*мин\.?', '', 'g'), ',', 1), '[ •·,;-]+$', '')) END"""
_CLEAN = lambda c: rf"NULLIF(TRIM(REGEXP_REPLACE({c}, '\s+', ' ', 'g')), '') AS {c}"
LISTING = rf"""SELECT * EXCLUDE (ok) FROM (SELECT id, source, deal_type, external_id, url, {_CLEAN('title')}, {_CLEAN('description')},
  ROUND(CASE WHEN deal_type = 'rent_daily' THEN price_value * 3e1 ELSE price_value END, 2) AS price_rub,
  CASE WHEN deal_type IN ('rent_long', 'rent_daily') THEN 'month' END AS price_period,
  CASE WHEN price_value IS NOT NULL AND area_total > 0 THEN ROUND(ROUND(CASE WHEN deal_type = 'rent_daily' THEN price_value * 3e1 ELSE price_value END, 2) / area_total, 2) END AS price_per_m2,
  rooms, area_total, CASE WHEN price_value IS NOT NULL AND area_total > 0 AND area_living > area_total THEN NULL ELSE area_living END AS area_living, area_kitchen,
  floor, floors_total, year_built, house_material, condition, {_CLEAN('address_text')[:-len('address_text')]}address_norm, city, COALESCE(district, '') AS district, {_CLEAN('metro')},
  NULLIF(COALESCE(NULLIF({_STATION}, ''), metro_station), '') AS metro_station, CASE WHEN {_HIT} THEN NULLIF(CAST(REGEXP_EXTRACT({_MT}, '{_MAIN}', 2) AS INT), 0) END AS metro_walk_min,
  CAST(NULL AS VARCHAR) AS contact_phone_hash, TRUE AS is_active, collected_at AS first_seen, collected_at AS last_seen, lat, lon,
  COALESCE(price_value IS NOT NULL AND area_total > 0 AND floor > floors_total, FALSE) AS ok
FROM listing_raw WHERE rooms IS NOT NULL AND year_built IS NOT NULL) t WHERE NOT ok"""

BUCKET = "CASE WHEN rooms IS NULL THEN 'other' WHEN rooms <= 0 THEN 'studio' WHEN rooms <= 4 THEN 'r' || CAST(rooms AS VARCHAR) ELSE 'r5p' END"
CELL = "CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN CAST(CAST(FLOOR(lat / 0.02e0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(FLOOR(lon / 0.03e0) AS BIGINT) AS VARCHAR) END"


def metres(a: str, b: str, r: str = "6371008.8e0") -> str:
    """SQL for the distance of two points, each `table.` or a pair of columns."""
    (y1, x1), (y2, x2) = (x.split() if " " in x else (f"{x}lat", f"{x}lon") for x in (a, b))
    s = f"(POWER(SIN(RADIANS({y2} - {y1}) / 2e0), 2) + COS(RADIANS({y1})) * COS(RADIANS({y2})) * POWER(SIN(RADIANS({x2} - {x1}) / 2e0), 2))"
    return f"(2e0 * ASIN(CASE WHEN {s} > 1 THEN 1e0 ELSE SQRT({s}) END) * {r})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; `sql` follows the views, `listing` among them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = star.with_views("").rstrip() + f",\nlisting AS ({LISTING})\n" + sql if not sql.startswith("plain:") else sql[6:]
        return f

    return add


def with_(ctes: str, sql: str) -> str:
    """More common table expressions behind the views, then the query."""
    return f", {ctes}\n{sql}"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return star.view(spark, d, "listing_raw")


def listing(spark: SparkSession, d: str) -> DataFrame:
    return clean.normalize(raw(spark, d))


# -- minimum slice ---------------------------------------------------------------------------

STATS = f"priced AS (SELECT *, {CELL} AS cell, {BUCKET} AS bucket FROM listing WHERE is_active AND deal_type <> 'sale'), mean AS (SELECT AVG(price_rub) AS m FROM priced), st AS (SELECT cell, bucket, SUM(price_rub) AS s, COUNT(*) AS n FROM priced WHERE cell IS NOT NULL AND price_rub IS NOT NULL GROUP BY cell, bucket)"


def rents(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).where("is_active and deal_type <> 'sale'")
    return rows.withColumns({"cell": geo.cell("lat", "lon"), "rooms_bucket": tx.rooms_bucket("rooms")})


@query(with_(STATS, "SELECT cell, bucket AS rooms_bucket, ROUND(s / n, 4) AS mean_price, CAST(n AS BIGINT) AS n FROM st"))
def local_price_stats(spark: SparkSession, d: str) -> DataFrame:
    return features.local_stats(rents(spark, d)).select("cell", "rooms_bucket", F.round(F.col("price_sum") / F.col("price_n"), 4).alias("mean_price"), F.col("price_n").alias("n"))


@query(with_(STATS, "SELECT p.id, ROUND(COALESCE(st.s / st.n, mean.m), 4) AS local_avg, CAST(COALESCE(st.n, 0) AS BIGINT) AS local_n FROM priced p CROSS JOIN mean LEFT JOIN st ON p.cell = st.cell AND p.bucket = st.bucket"))
def local_price_attach(spark: SparkSession, d: str) -> DataFrame:
    rows = rents(spark, d)
    out = features.with_local_price(rows, features.local_stats(rows), features.global_mean(rows))
    return out.select("id", F.round("local_avg_price_rub", 4).alias("local_avg"), F.col("local_density_count").alias("local_n"))


@query(with_(STATS, "SELECT p.id, ROUND(CASE WHEN p.price_rub IS NULL OR COALESCE(st.n, 0) <= 1 THEN mean.m ELSE (st.s - p.price_rub) / (st.n - 1) END, 4) AS local_avg, CAST(COALESCE(st.n, 0) AS BIGINT) AS local_n FROM priced p CROSS JOIN mean LEFT JOIN st ON p.cell = st.cell AND p.bucket = st.bucket"))
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return features.leave_one_out(rents(spark, d)).select("id", F.round("local_avg_price_rub", 4).alias("local_avg"), F.col("local_density_count").alias("local_n"))


# -- projections and filters -----------------------------------------------------------------


_ALL = ["id", "source", "deal_type", "external_id", "url", "title", "description", "price_rub", "price_period", "price_per_m2", "rooms", "area_total", "area_living", "area_kitchen", "floor", "floors_total", "year_built", "house_material", "condition", "address_norm", "city", "district", "metro", "metro_station", "metro_walk_min", "is_active", "first_seen", "last_seen", "lat", "lon"]


@query(f"SELECT {', '.join(_ALL)} FROM listing")
def normalized(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).select(*_ALL)


_NUMBERS = ["price_per_m2", "rooms", "area_total", "area_living", "area_kitchen", "floor", "floors_total", "year_built", "lat", "lon", "metro_walk_min"]


@query(f"SELECT id, TRY_CAST(CASE WHEN id % 5 = 0 THEN 'n/a' ELSE CAST(price_rub AS VARCHAR) END AS DOUBLE) AS price_rub, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUMBERS)}, CASE WHEN id % 3 = 0 THEN TRUE WHEN id % 3 = 1 THEN FALSE END AS is_active FROM listing")
def coerced_types(spark: SparkSession, d: str) -> DataFrame:
    messy = listing(spark, d).withColumns({"price_rub": F.when(F.col("id") % 5 == 0, "n/a").otherwise(F.col("price_rub").cast("string")), **{c: F.col(c).cast("string") for c in _NUMBERS}, "is_active": F.when(F.col("id") % 3 == 0, "True").when(F.col("id") % 3 == 1, "false").otherwise("?")})
    return clean.coerce_types(messy).select("id", "price_rub", *_NUMBERS, "is_active")


@query("SELECT id, price_rub FROM listing WHERE price_rub BETWEEN 10000 AND 600000")
def target_range(spark: SparkSession, d: str) -> DataFrame:
    return clean.in_target_range(listing(spark, d)).select("id", "price_rub")


@query("SELECT city, price_rub, rooms, area_total, url FROM listing WHERE is_active AND deal_type = 'rent_long'")
def active_export(spark: SparkSession, d: str) -> DataFrame:
    return clean.active(listing(spark, d), "rent_long", ["city", "price_rub", "rooms", "area_total", "url"])


_TEXTS = ["deal_type", "city", "district", "price_period", "house_material", "condition", "metro_station"]


@query(f"SELECT {', '.join(_TEXTS)}, CAST(price_rub AS DOUBLE) AS price_rub, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUMBERS)}, CAST(NULL AS DOUBLE) AS dist_to_metro_m, CAST(NULL AS DOUBLE) AS dist_to_center_km, CAST(NULL AS DOUBLE) AS density_500m, CAST(EPOCH(first_seen) AS BIGINT) AS first_seen, CAST(EPOCH(last_seen) AS BIGINT) AS last_seen FROM listing WHERE is_active")
def export_listings(spark: SparkSession, d: str) -> DataFrame:
    return io.export_listings(listing(spark, d)).withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})


@query("SELECT deal_type, COUNT(*) AS n, ROUND(SUM(price_rub), 2) AS total FROM listing GROUP BY deal_type")
def export_by_sql(spark: SparkSession, d: str) -> DataFrame:
    return io.export_listings(listing(spark, d), "SELECT deal_type, count(*) AS n, round(sum(price_rub), 2) AS total FROM listing_master GROUP BY deal_type")


@query("SELECT id, CAST(floor AS DOUBLE) AS floor, CAST(NULL AS DOUBLE) AS balcony, house_material, CAST(is_active AS VARCHAR) AS is_active, district, '' AS facade FROM listing")
def aligned_schema(spark: SparkSession, d: str) -> DataFrame:
    out = clean.align_to_schema(listing(spark, d), ["floor", "balcony"], ["house_material", "is_active", "district", "facade"])
    return out.select("id", "floor", "balcony", "house_material", "is_active", "district", "facade")


@query(f"SELECT id, CASE WHEN (deal_type = 'rent_long' AND last_seen < {TS} - INTERVAL 250 DAY) OR (deal_type = 'sale' AND last_seen < {TS} - INTERVAL 300 DAY) THEN FALSE ELSE is_active END AS is_active FROM listing")
def deactivated(spark: SparkSession, d: str) -> DataFrame:
    return clean.deactivate(listing(spark, d), star.as_of()).select("id", "is_active")


@query(f"SELECT city, address_norm FROM geocode_cache WHERE {TS} - created_at <= INTERVAL 1200 DAY")
def fresh_cache(spark: SparkSession, d: str) -> DataFrame:
    return star.view(spark, d, "geocode_cache").where(clean.fresh("created_at", star.as_of(), 1200)).select("city", "address_norm")


@query("SELECT id, url FROM listing ORDER BY id LIMIT 100")
def first_in_order(spark: SparkSession, d: str) -> DataFrame:
    return clean.first_in_order(listing(spark, d), ["id"], 100).select("id", "url")


@query(r"plain:SELECT page_id, COALESCE(NULLIF(REGEXP_EXTRACT(url, '([0-9]{6,})', 1), ''), REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(url, '^https://', ''), '^http://', ''), '^/+|/+$', '', 'g'), '/', '-', 'g'), '^-+|-+$', '', 'g')) AS external_id FROM pages")
def external_ids(spark: SparkSession, d: str) -> DataFrame:
    return star.view(spark, d, "pages").select("page_id", tx.external_id("url").alias("external_id"))


SCALARS = f"""SELECT id, CASE WHEN deal_type = 'rent_daily' THEN price_value * 30.44e0 ELSE price_value END AS monthly,
  CASE WHEN price_value IS NOT NULL AND area_total > 0 THEN ROUND(price_value / area_total, 2) END AS ppm, {BUCKET} AS bucket,
  LOWER(TRIM(REGEXP_REPLACE(address_text, '\\s+', ' ', 'g'))) AS addr, SHA1(LOWER(TRIM(address_text))) AS addr_hash,
  CASE WHEN year_built IS NOT NULL THEN GREATEST(2001 - year_built, 0) END AS age, ROUND(price_value / NULLIF(area_total, 0), 6) AS ppm_calc,
  CAST(REPLACE(CAST(CAST(area_total AS BIGINT) AS VARCHAR), '.', ',') AS DOUBLE) AS parsed, ROUND(LN(GREATEST(price_value, 1e0)), 9) AS log_price,
  {CELL} AS cell, CAST(CEIL(area_total * 20 / 80) AS INT) AS walk,
  ROUND(POWER(LN(LEAST(GREATEST(area_total / 60e0, 0.2e0), 5e0)), 2), 9) AS penalty FROM listing_raw"""


@query(SCALARS)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(
        "id", tx.monthly_price("deal_type", "price_value", 0).alias("monthly"), tx.price_per_m2("price_value", "area_total").alias("ppm"), tx.rooms_bucket("rooms").alias("bucket"),
        F.trim(tx.canon_addr("address_text")).alias("addr"), tx.address_hash("address_text").alias("addr_hash"), tx.house_age("year_built", star.as_of()).alias("age"), F.round(tx.price_per_m2_calc("price_value", "area_total"), 6).alias("ppm_calc"),
        tx.number(F.col("area_total").cast("long").cast("string")).alias("parsed"), F.round(tx.log_target("price_value"), 9).alias("log_price"), geo.cell("lat", "lon").alias("cell"), geo.walk_min(F.col("area_total") * 20).alias("walk"),
        F.round(tx.area_penalty(F.col("area_total"), F.lit(60.0)), 9).alias("penalty"),
    )


@query("SELECT building_id, CAST(NULLIF(REGEXP_EXTRACT(start_date, '((18|19|20)[0-9]{2})', 1), '') AS INT) AS year_built, floors_total, house_material FROM building")
def osm_attributes(spark: SparkSession, d: str) -> DataFrame:
    b = star.view(spark, d, "building")
    tags = F.create_map(F.lit("building:levels"), F.col("floors_total").cast("string"), F.lit("start_date"), F.col("start_date"), F.lit("material"), F.col("house_material"))
    return b.select("building_id", tx.osm_attributes(tags).alias("a")).select("building_id", "a.year_built", "a.floors_total", "a.house_material")


# -- joins -----------------------------------------------------------------------------------


@query(f"SELECT id, dist_m, station FROM (SELECT l.id, ROUND({metres('l.', 'm.')}, 3) AS dist_m, m.name AS station, ROW_NUMBER() OVER (PARTITION BY l.id ORDER BY {metres('l.', 'm.')}, m.name) AS r FROM listing l JOIN ref_metro m ON l.city = m.city WHERE l.lat IS NOT NULL AND l.lon IS NOT NULL) t WHERE r = 1")
def nearest_station(spark: SparkSession, d: str) -> DataFrame:
    return enrich.nearest_station(listing(spark, d), star.stations(spark, d)).select("id", F.round("dist_m", 3).alias("dist_m"), "station")


@query(f"SELECT l.id, ROUND({metres('l.lat l.lon', 'c.center_lat c.center_lon')} / 1000e0, 6) AS center_km, ROUND({metres('l.lat l.lon', 'c.center_lat c.center_lon', '6371e0')}, 6) AS haversine_km FROM listing l LEFT JOIN ref_city c ON l.city = c.city")
def center_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.center_distance_km(listing(spark, d), star.cities(spark, d))
    c = star.cities(spark, d).select("city", "center_lat", "center_lon")
    km = geo.haversine_km((F.col("lat"), F.col("lon")), (F.col("center_lat"), F.col("center_lon")))
    return rows.join(c, "city", "left").select("id", F.round("center_km", 6).alias("center_km"), F.round(km, 6).alias("haversine_km"))


NEAR = f"near AS (SELECT a.id AS id, b.id AS other, b.last_seen AS seen FROM listing a JOIN listing b ON a.city = b.city AND {metres('a.', 'b.')} <= 500e0)"  # cities lie far apart


@query(with_(NEAR, "SELECT id, COUNT(*) - 1 AS density FROM near GROUP BY id"))
def neighbour_density(spark: SparkSession, d: str) -> DataFrame:
    return enrich.neighbour_density(listing(spark, d))


@query(with_(NEAR, f"SELECT l.id, COUNT(n.other) AS density FROM listing l LEFT JOIN near n ON l.id = n.id AND n.seen >= {TS} - INTERVAL 900 DAY GROUP BY l.id"))
def recent_density(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    return enrich.density(rows, enrich.recent(rows, star.as_of(), 900))


PAIRS = f"""pair AS (SELECT l.id AS a, r.id AS b, l.price_rub AS lp, r.price_rub AS rp, l.floor AS lf, r.floor AS rf, l.year_built AS ly, r.year_built AS ry, l.house_material AS lm, r.house_material AS rm
  FROM listing l JOIN listing r ON l.city = r.city AND l.deal_type = r.deal_type AND l.id < r.id AND l.rooms IS NOT DISTINCT FROM r.rooms
  WHERE {metres('l.', 'r.')} <= 50e0 AND ABS(l.area_total - r.area_total) <= 2 AND (l.price_rub IS NULL OR r.price_rub IS NULL OR (l.price_rub > 0 AND r.price_rub > 0 AND ABS(l.price_rub - r.price_rub) / GREATEST(l.price_rub, r.price_rub) <= 0.05e0))),
scored AS (SELECT a, b, 0.4e0 + 0.25e0 + CASE WHEN lp IS NOT NULL AND rp IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN lf = rf THEN 0.1e0 ELSE 0e0 END + CASE WHEN ABS(ly - ry) <= 1 THEN 0.03e0 ELSE 0e0 END + CASE WHEN lm <> '' AND rm <> '' AND LEFT(lm, 3) = LEFT(rm, 3) THEN 0.02e0 ELSE 0e0 END AS score FROM pair),
kept AS (SELECT a, b, score FROM scored WHERE score >= 0.7e0),
edge AS (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
reach(node, root) AS (SELECT DISTINCT a, a FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node),
comp AS (SELECT node, MIN(root) AS root FROM reach GROUP BY node)"""
RECURSIVE = lambda sql: star.with_views("").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f",\nlisting AS ({LISTING}), {PAIRS}\n{sql}"


@query("plain:" + RECURSIVE("SELECT a, b FROM pair"))
def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.candidate_pairs(listing(spark, d)).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query("plain:" + RECURSIVE("SELECT a, b, ROUND(score, 6) AS score FROM kept"))
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.scored_pairs(dedupe.candidate_pairs(listing(spark, d))).withColumn("score", F.round("score", 6))


@query("plain:" + RECURSIVE("SELECT node, root FROM comp"))
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(dedupe.scored_pairs(dedupe.candidate_pairs(listing(spark, d))))


@query("plain:" + RECURSIVE("SELECT root, COUNT(*) AS members FROM comp GROUP BY root HAVING COUNT(*) >= 2"))
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.cluster_sizes(duplicate_components(spark, d))


@query("plain:" + RECURSIVE("SELECT l.id, l.city FROM listing l WHERE l.id IN (SELECT a FROM kept UNION SELECT b FROM kept)"))
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    pairs = dedupe.scored_pairs(dedupe.candidate_pairs(listing(spark, d)))
    return dedupe.rows_of(listing(spark, d), dedupe.pair_ids(pairs)).select("id", "city")


QUALITY = f"qual AS (SELECT l.id, c.root, (CASE WHEN area_total IS NULL THEN 0 ELSE 1 END + CASE WHEN price_rub IS NULL THEN 0 ELSE 1 END + CASE WHEN floor IS NULL THEN 0 ELSE 1 END + CASE WHEN year_built IS NULL THEN 0 ELSE 1 END + CASE WHEN house_material IS NULL THEN 0 ELSE 1 END + CASE WHEN lat IS NULL OR lon IS NULL THEN 0 ELSE 2 END) + 3e0 / (1e0 + GREATEST((EPOCH({TS}) - EPOCH(last_seen)) / 86400e0, 0e0)) AS q FROM listing l JOIN comp c ON l.id = c.node), ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY root ORDER BY q DESC, id) AS r FROM qual), best AS (SELECT root, id AS master FROM ranked WHERE r = 1)"
CLUSTERS = RECURSIVE("").rstrip() + f", {QUALITY}, cluster AS (SELECT b.master AS master_id, q.id AS member_id FROM qual q JOIN best b ON q.root = b.root WHERE q.id <> b.master)\n"


@query("plain:" + CLUSTERS + "SELECT c.master_id, c.member_id, 0.9e0 AS score, ROUND(MAX(k.score), 6) AS pair_score FROM cluster c JOIN kept k ON c.member_id = k.a OR c.member_id = k.b GROUP BY c.master_id, c.member_id")
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.clusters(listing(spark, d), star.as_of()).select("master_id", "member_id", F.col("score").cast("double").alias("score"), F.round("pair_score", 6).alias("pair_score"))


@query("plain:" + CLUSTERS + "SELECT root, master AS id FROM best")
def cluster_survivors(spark: SparkSession, d: str) -> DataFrame:
    groups = duplicate_components(spark, d).withColumnRenamed("node", "id")
    return dedupe.survivors(listing(spark, d), groups, star.as_of())


@query("plain:" + CLUSTERS + "SELECT city, COUNT(*) AS n FROM listing WHERE id NOT IN (SELECT member_id FROM cluster) GROUP BY city")
def masters_by_city(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    return clean.masters(rows, dedupe.clusters(rows, star.as_of())).groupBy("city").agg(F.count("*").alias("n"))


GEOCODED = "filled AS (SELECT l.id, l.city, l.address_norm, COALESCE(l.lat, g.lat) AS lat, COALESCE(l.lon, g.lon) AS lon, CASE WHEN l.lat IS NOT NULL AND l.lon IS NOT NULL THEN 'own' WHEN g.lat IS NOT NULL THEN 'cache' END AS geo_source FROM listing l LEFT JOIN geocode_cache g ON l.city = g.city AND LOWER(l.address_norm) = g.address_norm)"


@query(with_(GEOCODED, "SELECT id, lat, lon, geo_source FROM filled"))
def geocode_filled(spark: SparkSession, d: str) -> DataFrame:
    return geocode.geocode(listing(spark, d), star.view(spark, d, "geocode_cache"))[0].select("id", "lat", "lon", "geo_source")


@query(with_(GEOCODED, "SELECT DISTINCT CASE WHEN CONTAINS(address_norm, city) THEN address_norm ELSE city || ', ' || address_norm END AS query, SHA1(LOWER(address_norm)) AS address_hash FROM filled WHERE (lat IS NULL OR lon IS NULL) AND address_norm IS NOT NULL"))
def geocode_work_list(spark: SparkSession, d: str) -> DataFrame:
    return geocode.geocode(listing(spark, d), star.view(spark, d, "geocode_cache"))[1]


@query(f"SELECT request_id, pos, lat, lon FROM (SELECT g.*, ROW_NUMBER() OVER (PARTITION BY g.request_id ORDER BY CASE WHEN CONTAINS(LOWER(g.cand_city), LOWER(r.city)) THEN 0 ELSE 1 END, ROUND({metres('c.center_lat c.center_lon', 'g.lat g.lon', '6371e0')}, 9), g.pos) AS n FROM geocode_candidate g JOIN request r ON g.request_id = r.request_id JOIN ref_city c ON r.city = c.city) t WHERE n = 1")
def picked_geocodes(spark: SparkSession, d: str) -> DataFrame:
    c = star.view(spark, d, "geocode_candidate").join(star.view(spark, d, "request").select("request_id", "city"), "request_id")
    return geocode.pick_candidate(c, star.cities(spark, d))


BUILT = f"""bc AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY city, address_norm ORDER BY created_at DESC, floors_total DESC, year_built DESC NULLS LAST) AS r FROM building_cache) t WHERE r = 1 AND {TS} - created_at <= INTERVAL 2000 DAY),
own AS (SELECT l.id, l.city, l.lat, l.lon, LOWER(TRIM(REGEXP_REPLACE(l.address_text, '\\s+', ' ', 'g'))) AS addr, COALESCE(NULLIF(l.floors_total, 0), NULLIF(c.floors_total, 0)) AS floors_total, COALESCE(NULLIF(l.year_built, 0), NULLIF(c.year_built, 0)) AS year_built, COALESCE(NULLIF(l.house_material, ''), NULLIF(c.house_material, '')) AS house_material
  FROM listing_raw l LEFT JOIN bc c ON l.city = c.city AND LOWER(TRIM(REGEXP_REPLACE(l.address_text, '\\s+', ' ', 'g'))) = c.address_norm),
nearb AS (SELECT * FROM (SELECT l.id, b.building_id, b.floors_total, CAST(NULLIF(REGEXP_EXTRACT(b.start_date, '((18|19|20)[0-9]{{2}})', 1), '') AS INT) AS year_built, b.house_material, ROW_NUMBER() OVER (PARTITION BY l.id ORDER BY {metres('l.', 'b.')}, b.building_id) AS r FROM own l JOIN building b ON l.city = b.city AND {metres('l.', 'b.')} <= 60e0 WHERE l.floors_total IS NULL OR l.year_built IS NULL OR l.house_material IS NULL) t WHERE r = 1)""".replace("\\\\", "\\")


def _filled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tags = F.create_map(F.lit("start_date"), F.col("start_date"))
    b = star.view(spark, d, "building").withColumn("year_built", tx.osm_attributes(tags)["year_built"])
    return geocode.fill_building(raw(spark, d), b, star.view(spark, d, "building_cache"), address="address_text", as_of=star.as_of(), max_age_days=2000)


@query(with_(BUILT, "SELECT o.id, COALESCE(o.floors_total, n.floors_total) AS floors_total, COALESCE(o.year_built, n.year_built) AS year_built, COALESCE(o.house_material, n.house_material) AS house_material FROM own o LEFT JOIN nearb n ON o.id = n.id"))
def building_filled(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)[0].select("id", "floors_total", "year_built", "house_material")


@query(with_(BUILT, "SELECT city, address_norm, lat, lon, floors_total, year_built, house_material FROM (SELECT o.city, o.addr AS address_norm, o.lat, o.lon, n.floors_total, n.year_built, n.house_material, ROW_NUMBER() OVER (PARTITION BY o.city, o.addr ORDER BY o.id) AS r FROM own o JOIN nearb n ON o.id = n.id) t WHERE r = 1"))
def building_cache_rows(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)[1].drop("created_at")


# -- upserts and history ---------------------------------------------------------------------

MERGE = "tgt AS (SELECT id, external_id, CASE WHEN id % 3 = 0 THEN price_rub + 1000 ELSE price_rub END AS price_rub, rooms, last_seen FROM listing WHERE id % 5 <> 0), merged AS (SELECT COALESCE(t.external_id, s.external_id) AS external_id, CASE WHEN t.external_id IS NULL OR (s.price_rub, s.rooms) IS DISTINCT FROM (t.price_rub, t.rooms) THEN s.price_rub ELSE t.price_rub END AS price_rub, CASE WHEN t.external_id IS NULL THEN 'inserted' WHEN s.price_rub IS DISTINCT FROM t.price_rub OR s.rooms IS DISTINCT FROM t.rooms THEN 'updated' ELSE 'unchanged' END AS action FROM listing s LEFT JOIN tgt t ON s.external_id = t.external_id)"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).select("external_id", "price_rub", "rooms", "id", "last_seen")
    target = rows.where("id % 5 <> 0").withColumn("price_rub", F.when(F.col("id") % 3 == 0, F.col("price_rub") + 1000).otherwise(F.col("price_rub")))
    return merge.merge_upsert(target, rows, ["external_id"], ["price_rub", "rooms"], ["id"], ["last_seen"])


@query(with_(MERGE, "SELECT external_id, price_rub, action FROM merged"))
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("external_id", "price_rub", "action")


@query(with_(MERGE, "SELECT action, COUNT(*) AS n FROM merged GROUP BY action"))
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert_counts(_merged(spark, d))


@query("SELECT id, ROW_NUMBER() OVER (ORDER BY id) + (SELECT MAX(id) FROM listing) AS new_id FROM listing_raw WHERE id NOT IN (SELECT id FROM listing)")
def continued_ids(spark: SparkSession, d: str) -> DataFrame:
    known = listing(spark, d).select(F.col("id").alias("new_id"))
    new = raw(spark, d).select("id").join(listing(spark, d).select("id"), "id", "left_anti")
    return merge.continued_ids(known, new, "new_id", ["id"]).select("id", "new_id")


_STAMPED = f"""'{{"clerk":"' || JSON_EXTRACT_STRING(payload, '$.clerk') || '","ingested_at":"{star.AS_OF}"}}'"""


@query(f"SELECT s.external_id, s.price_value, s.rooms, s.area_total, s.url, {_STAMPED} AS payload, CASE WHEN s.id % 5 = 0 THEN 'inserted' ELSE 'updated' END AS action FROM listing_raw s WHERE s.id % 2 = 0 UNION ALL SELECT external_id, CASE WHEN id % 7 = 0 THEN price_value + 1 ELSE price_value END, rooms, area_total, url, payload, 'kept' FROM listing_raw WHERE id % 2 <> 0 AND id % 5 <> 0")
def raw_upserted(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d)
    known = rows.where("id % 5 <> 0").withColumn("price_value", F.when(F.col("id") % 7 == 0, F.col("price_value") + 1).otherwise(F.col("price_value")))
    batch = rows.where("id % 2 = 0")
    return io.upsert_raw(known, batch.union(batch), F.lit(star.AS_OF)).select("external_id", "price_value", "rooms", "area_total", "url", "payload", "action")


@query("SELECT listing_id, ts, seq, price_rub FROM (SELECT *, LAG(price_rub) OVER (PARTITION BY listing_id ORDER BY ts, seq) AS p FROM price_obs) t WHERE price_rub IS NOT NULL AND price_rub IS DISTINCT FROM p")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    return history.price_changes(star.view(spark, d, "price_obs"))


@query("SELECT listing_id, price_rub FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY listing_id ORDER BY ts DESC, seq DESC) AS r FROM price_obs) t WHERE r = 1")
def last_prices(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_write(star.view(spark, d, "price_obs"), ["listing_id"], ["ts", "seq"]).select("listing_id", "price_rub")


# -- statistics ------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT COUNT(*) FILTER (deal_type = 'rent_long' AND is_active) AS rent_count, COUNT(*) FILTER (deal_type = 'sale' AND is_active) AS sale_count, COUNT(*) FILTER (is_active) AS total FROM listing) a, (SELECT COUNT(*) FILTER (deal_type = 'rent_long') AS rent_raw_count, COUNT(*) FILTER (deal_type = 'sale') AS sale_raw_count, COUNT(*) AS total_raw FROM listing_raw) b")
def data_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.data_stats(listing(spark, d), raw(spark, d))


@query("SELECT MEDIAN(price_rub) AS price_rub, MEDIAN(area_total) AS area_total, CAST(MEDIAN(floor) AS DOUBLE) AS floor FROM listing")
def medians(spark: SparkSession, d: str) -> DataFrame:
    return stats.medians(listing(spark, d), ["price_rub", "area_total", "floor"])


@query("SELECT name, value, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY n DESC, value NULLS FIRST) AS r FROM (SELECT 'house_material' AS name, house_material AS value, COUNT(*) AS n FROM listing GROUP BY house_material UNION ALL SELECT 'condition', condition, COUNT(*) FROM listing GROUP BY condition) t) u WHERE r = 1")
def modes(spark: SparkSession, d: str) -> DataFrame:
    return features.modes(listing(spark, d), ["house_material", "condition"])


@query("SELECT id, COALESCE(area_total, (SELECT MEDIAN(area_total) FROM listing)) AS area_total, COALESCE(house_material, '') AS house_material FROM listing")
def imputed(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    known = stats.medians(rows, ["area_total"]).first().asDict()
    return features.impute(rows.select("id", "area_total", "house_material"), known, {"house_material": None})


ERR = "err AS (SELECT l_extendedprice AS y, l_quantity * 15e2 AS p FROM lineitem)"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return star.view(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity").cast("double") * 1500).alias("p"))


@query(with_(ERR, "SELECT ROUND(AVG(ABS(y - p)), 4) AS mae, ROUND(SQRT(AVG((y - p) * (y - p))), 4) AS rmse, ROUND(AVG(CASE WHEN y <> 0 THEN ABS((y - p) / y) END) * 100, 6) AS mape FROM err"))
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.errors(_errors(spark, d), "y", "p").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 6).alias("mape"))


@query(with_(ERR, "SELECT ROUND(QUANTILE_CONT(ABS(y - p), 0.9), 4) AS eps, ROUND(QUANTILE_CONT(y - p, 0.1), 4) AS low, ROUND(QUANTILE_CONT(y - p, 0.9), 4) AS high FROM err"))
def interval_radius(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    both = stats.conformal_radius(e, "y", "p").crossJoin(stats.residual_quantiles(e, "y", "p"))  # one row each
    return both.select(*[F.round(c, 4).alias(c) for c in ("eps", "low", "high")])


@query("SELECT l_orderkey, l_linenumber, LEAST(l_extendedprice - 100, l_quantity * 15e2, l_extendedprice + 100) AS low, GREATEST(l_extendedprice - 100, l_quantity * 15e2, l_extendedprice + 100) AS high FROM lineitem")
def repaired_intervals(spark: SparkSession, d: str) -> DataFrame:
    x = star.view(spark, d, "lineitem")
    i = tx.repair_interval(F.col("l_extendedprice") - 100, F.col("l_quantity") * 1500.0, F.col("l_extendedprice") + 100)
    return x.select("l_orderkey", "l_linenumber", i.alias("i")).select("l_orderkey", "l_linenumber", "i.low", "i.high")


@query(f"SELECT l.id, ROUND({metres('l.lat l.lon', 'c.center_lat c.center_lon')} / 1000e0, 6) AS center_km, CASE WHEN year_built IS NOT NULL THEN GREATEST(2001 - year_built, 0) END AS age_house, ROUND(price_rub / NULLIF(area_total, 0), 6) AS price_per_m2_calc, {CELL} AS cell, {BUCKET} AS rooms_bucket FROM listing l LEFT JOIN ref_city c ON l.city = c.city")
def listing_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.features(listing(spark, d), star.stations(spark, d), star.cities(spark, d), star.as_of())
    return f.select("id", F.round("dist_to_center_km", 6).alias("center_km"), "age_house", F.round("price_per_m2_calc", 6).alias("price_per_m2_calc"), "cell", "rooms_bucket")


@query("SELECT CASE WHEN EPOCH_US(last_seen) <= (SELECT MAX(EPOCH_US(last_seen)) FROM listing) - 200 * 86400000000 THEN 'train' ELSE 'valid' END AS part, COUNT(*) AS n, MIN(last_seen) AS first FROM listing GROUP BY 1")
def time_split_days(spark: SparkSession, d: str) -> DataFrame:
    a, b = features.time_split(listing(spark, d), "last_seen", days=200)
    rows = a.withColumn("part", F.lit("train")).union(b.withColumn("part", F.lit("valid")))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("last_seen").alias("first"))


@query("SELECT CASE WHEN EPOCH_US(last_seen) <= (SELECT QUANTILE_CONT(CAST(EPOCH_US(last_seen) AS DOUBLE), 0.7) FROM listing) THEN 'train' ELSE 'valid' END AS part, COUNT(*) AS n FROM listing GROUP BY 1")
def time_split_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = features.time_split(listing(spark, d), "last_seen", ratio=0.3)
    return a.withColumn("part", F.lit("train")).union(b.withColumn("part", F.lit("valid"))).groupBy("part").agg(F.count("*").alias("n"))


# -- requests and reports --------------------------------------------------------------------

KM = metres("t.", "l.", "6371e0")
COMPS = f"""tg AS (SELECT * FROM request WHERE lat IS NOT NULL AND lon IS NOT NULL),
met AS (SELECT t.request_id, l.id, {KM} AS km, {KM} + POWER(LN(LEAST(GREATEST(l.area_total / t.area_total, 0.2e0), 5e0)), 2) AS score, {BUCKET.replace('rooms', 'l.rooms')} = {BUCKET.replace('rooms', 't.rooms')} AS same, l.price_rub, l.area_total FROM tg t JOIN listing l ON t.city = l.city AND l.deal_type = 'rent_long' AND l.price_rub IS NOT NULL AND l.area_total IS NOT NULL WHERE {KM} <= 3e0),
pick AS (SELECT *, MAX(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS any_same FROM met),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY score, id) AS rank FROM pick WHERE same OR any_same = 0)"""


_TOLD = ["deal_type", "city", "district", "price_rub", "price_per_m2", "rooms", "area_total", "area_living", "area_kitchen", "floor", "floors_total", "year_built", "house_material", "condition", "lat", "lon", "metro_station", "metro_walk_min", "address_norm", "url"]


@query(with_(COMPS, f"SELECT b.request_id, CAST(b.rank AS INT) AS rank, b.id, ROUND(b.km, 6) AS distance_km, ROUND(b.score, 6) AS score, {', '.join(f'l.{c}' for c in _TOLD)} FROM best b JOIN listing l ON b.id = l.id WHERE b.rank <= 5"))
def comparables(spark: SparkSession, d: str) -> DataFrame:
    c = comps.comparables(star.view(spark, d, "request"), listing(spark, d))
    return c.select("request_id", "rank", "id", F.round("distance_km", 6).alias("distance_km"), F.round("score", 6).alias("score"), *_TOLD)


_INFO = {"model_name": "trees", "target": "price_rub", "log_target": True, "valid_mae": 1.5, "valid_rmse": 2.5, "valid_mape": 3.5}


def _reports(spark: SparkSession, d: str) -> DataFrame:
    r = star.view(spark, d, "request").withColumn("metro_walk_min", F.lit(7))
    p = r.select("request_id", (F.col("area_total") * 1000).alias("prediction_rub"), (F.col("area_total") * 900).alias("interval_low_rub"), (F.col("area_total") * 1100).alias("interval_high_rub"))
    return reports.valuation_reports(r, p, listing(spark, d), model_info=_INFO, generated_at=F.lit(star.AS_OF))


GROUPED = lambda n: f"SELECT request_id, COUNT(*) AS n, ROUND(SUM(price_rub), 2) AS s, ROUND(SUM(km), 6) AS km FROM best WHERE rank <= {n} GROUP BY request_id"
_HASHED = f"MD5('report|' || CAST(r.request_id AS VARCHAR) || '|{star.AS_OF}')"
REPORT_ID = f"SUBSTRING({_HASHED}, 1, 8) || '-' || SUBSTRING({_HASHED}, 9, 4) || '-' || SUBSTRING({_HASHED}, 13, 4) || '-' || SUBSTRING({_HASHED}, 17, 4) || '-' || SUBSTRING({_HASHED}, 21, 12)"
SHORT = "'Объект в городе ' || r.city || ', по адресу «' || r.address || '». Оценочная ставка аренды: ~' || CAST(CAST(r.area_total AS BIGINT) AS VARCHAR) || ' 000 ₽/мес (диапазон ' || CAST(CAST(r.area_total * 0.9 AS BIGINT) AS VARCHAR) || ' 000–' || CAST(CAST(r.area_total * 1.1 AS BIGINT) AS VARCHAR) || ' 000 ₽/мес).'"
PRICES = "r.area_total * 1000 AS prediction_rub, r.area_total * 900 AS interval_low_rub, r.area_total * 1100 AS interval_high_rub, 'RUB' AS currency, 'rent_long' AS deal_type"


def _told(n: int) -> list:
    """Number, prices and kilometres of the first comparables."""
    first = F.coalesce(F.slice("comparables", 1, n), F.array())
    total = lambda c, places: F.when(F.size(first) > 0, F.round(F.aggregate(first, F.lit(0.0), lambda a, x: a + x[c]), places))
    return [F.size(first).cast("long").alias("comps"), total("price_rub", 2).alias("comps_price"), total("distance_km", 6).alias("comps_km")]


@query(with_(COMPS, f"SELECT r.request_id, {REPORT_ID} AS report_id, '{star.AS_OF}' AS generated_at, r.address, r.city, r.rooms, r.area_total, CAST(NULL AS DOUBLE) AS area_kitchen, CAST(NULL AS INT) AS floor, CAST(NULL AS VARCHAR) AS condition, r.lat, r.lon, 7 AS metro_walk_min, CAST(NULL AS BIGINT) AS density_500m, {PRICES}, 'trees' AS model_name, 'price_rub' AS target, TRUE AS log_target, 1.5e0 AS valid_mae, 2.5e0 AS valid_rmse, 3.5e0 AS valid_mape, COALESCE(g.n, 0) AS comps, g.s AS comps_price, g.km AS comps_km, {SHORT} AS summary_long FROM request r LEFT JOIN ({GROUPED(5)}) g ON r.request_id = g.request_id"))
def valuation_reports(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, cols: [F.col(f"{name}.{c}") for c in cols]
    return _reports(spark, d).select("request_id", "report_id", "generated_at", *part("object", ["address", "city", "rooms", "area_total", "area_kitchen", "floor", "condition"]), *part("enriched", ["lat", "lon", "metro_walk_min", "density_500m"]), "pricing.*", "model_info.*", *_told(5), "text.summary_long")


@query(with_(COMPS, f"SELECT r.request_id, {REPORT_ID} AS report_id, r.city, r.address, r.rooms, r.area_total, CAST(NULL AS INT) AS floors_total, {PRICES}, {SHORT} AS summary_short, {SHORT} AS summary_long, 0 AS factors, COALESCE(g.n, 0) AS comps, g.s AS comps_price, g.km AS comps_km FROM request r LEFT JOIN ({GROUPED(3)}) g ON r.request_id = g.request_id"))
def thin_reports(spark: SparkSession, d: str) -> DataFrame:
    return reports.thin(_reports(spark, d)).select("request_id", "report_id", "object.city", "object.address", "object.rooms", "object.area_total", "object.floors_total", "price.*", "text.summary_short", "text.summary_long", F.size("text.factors_summary").alias("factors"), *_told(3))


@query(with_(COMPS, f"SELECT r.request_id, r.address, r.rooms, CAST(NULL AS VARCHAR) AS condition, r.lat, 7 AS metro_walk_min, r.area_total * 1000 AS prediction_rub, 'RUB' AS currency, CAST(b.rank AS INT) AS rank, l.price_rub, l.rooms AS comp_rooms, l.area_total, l.floor, l.floors_total, l.year_built, l.house_material, ROUND(b.km, 6) AS dist_km, l.metro_station AS metro FROM request r LEFT JOIN best b ON r.request_id = b.request_id AND b.rank <= 5 LEFT JOIN listing l ON b.id = l.id"))
def compact_reports(spark: SparkSession, d: str) -> DataFrame:
    comp = "struct<price_rub: double, rooms: int, area_total: double, floor: int, floors_total: int, year_built: int, house_material: string, dist_km: double, metro: string>"
    shape = f"struct<object: struct<address: string, rooms: int, condition: string>, geo: struct<lat: double, metro_walk_min: int>, pricing: struct<prediction_rub: double, currency: string>, comparables: array<{comp}>>"
    p = reports.compact(_reports(spark, d)).select("request_id", F.from_json("payload", shape).alias("p"))
    p = p.select("request_id", "p.object.*", "p.geo.*", "p.pricing.*", F.posexplode_outer("p.comparables").alias("rank", "c"))
    return p.select("request_id", "address", "rooms", "condition", "lat", "metro_walk_min", "prediction_rub", "currency", (F.col("rank") + 1).alias("rank"), "c.price_rub", F.col("c.rooms").alias("comp_rooms"), "c.area_total", "c.floor", "c.floors_total", "c.year_built", "c.house_material", F.round("c.dist_km", 6).alias("dist_km"), "c.metro")


REQ = f"""gc AS (SELECT * FROM geocode_cache WHERE {TS} - created_at <= INTERVAL 2000 DAY),
bc AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY city, address_norm ORDER BY created_at DESC, floors_total DESC, year_built DESC NULLS LAST) AS r FROM building_cache) t WHERE r = 1 AND {TS} - created_at <= INTERVAL 2000 DAY),
cached AS (SELECT r.request_id, r.city, r.address, COALESCE(r.lat, g.lat) AS lat, COALESCE(r.lon, g.lon) AS lon, r.rooms, r.area_total, NULLIF(c.floors_total, 0) AS floors_total, NULLIF(c.year_built, 0) AS year_built, NULLIF(c.house_material, '') AS house_material FROM request r LEFT JOIN gc g ON r.city = g.city AND LOWER(r.address) = g.address_norm LEFT JOIN bc c ON r.city = c.city AND LOWER(r.address) = c.address_norm),
nb AS (SELECT * FROM (SELECT q.request_id, b.floors_total, b.house_material, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY {metres('q.', 'b.')}, b.building_id) AS r FROM cached q JOIN building b ON q.city = b.city AND {metres('q.', 'b.')} <= 60e0) t WHERE r = 1)"""


@query(with_(REQ, "SELECT c.request_id, c.lat, c.lon, COALESCE(c.floors_total, nb.floors_total) AS floors_total, c.year_built, COALESCE(c.house_material, nb.house_material) AS house_material, CASE WHEN rooms IS NULL THEN 'rooms' WHEN lat IS NULL OR lon IS NULL THEN 'not found' END AS reject FROM cached c LEFT JOIN nb ON c.request_id = nb.request_id"))
def resolved_requests(spark: SparkSession, d: str) -> DataFrame:
    b = star.view(spark, d, "building").withColumn("year_built", F.lit(None).cast("int"))
    r, _ = reports.resolve_requests(star.view(spark, d, "request"), star.view(spark, d, "geocode_cache"), b, building_cache=star.view(spark, d, "building_cache"), as_of=star.as_of(), max_age_days=2000)
    return r.select("request_id", "lat", "lon", "floors_total", "year_built", "house_material", "reject")


@query("plain:SELECT o_orderkey AS id, o_orderdate AS created_at, 'No ' || CAST(o_orderkey AS VARCHAR) AS summary_short FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def report_list(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.struct(F.struct(F.concat(F.lit("No "), F.col("o_orderkey").cast("string")).alias("summary_short")).alias("text")))
    store = star.view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), text.alias("raw_report"))
    return reports.list_reports(store, 0, 40)


# -- pages -----------------------------------------------------------------------------------


@query(r"""plain:SELECT page_id, href FROM (SELECT page_id, UNNEST(REGEXP_EXTRACT_ALL(html, '(?i)href="([^"]*)"', 1)) AS href FROM pages WHERE NOT COALESCE(REGEXP_MATCHES(url, '/(en|[A-Z][a-z]+)([/?#]|$)'), FALSE)) t WHERE REGEXP_MATCHES(href, '/(en|[A-Z][a-z]+)([/?#]|$)')""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract_links(star.view(spark, d, "pages"), "/(en|[A-Z][a-z]+)")


@query(r"""plain:SELECT p.page_id, COALESCE(t.n, 0) AS n, t.n IS NULL AS is_empty FROM pages p LEFT JOIN (SELECT page_id, COUNT(*) AS n FROM (SELECT page_id, UNNEST(REGEXP_EXTRACT_ALL(html, '(?i)href="([^"]*)"', 1)) AS href FROM pages) u WHERE REGEXP_MATCHES(href, '/(en|[A-Z][a-z]+)([/?#]|$)') GROUP BY page_id) t ON p.page_id = t.page_id WHERE NOT COALESCE(REGEXP_MATCHES(p.url, '/(en|[A-Z][a-z]+)([/?#]|$)'), FALSE)""")
def page_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.link_counts(star.view(spark, d, "pages"), "/(en|[A-Z][a-z]+)")


def _heading(tag: str) -> str:
    """SQL for an element's text: no tags, entities decoded, trimmed."""
    text = f"REGEXP_REPLACE(REGEXP_EXTRACT(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '(?s)<[^>]*>', ' ', 'g')"
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"REPLACE({text}, '{name}', '{to}')"
    return f"NULLIF(TRIM({text}), '')"


@query(f"plain:SELECT page_id, {_heading('title')} AS title, {_heading('h1')} AS h1 FROM pages")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return pages.headings(star.view(spark, d, "pages"))


# Texts and pages made of the orders, so that what must be read out of them is known.
SAID = """said AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderkey % 6 + 1 AS rooms, 20 + o_orderkey % 90 AS area, o_orderkey % 20 + 1 AS floor, 5 + o_orderkey % 25 AS floors, 1890 + o_orderkey % 240 AS y,
  CASE o_orderkey % 5 WHEN 0 THEN 'Кирпично-монолитный дом' WHEN 1 THEN 'ПАНЕЛЬНЫЙ' WHEN 2 THEN 'монолит, каркас' WHEN 3 THEN 'Сталинка' ELSE 'дом' END AS material,
  CASE o_orderkey % 4 WHEN 0 THEN ' rub ' WHEN 1 THEN '₽' WHEN 2 THEN '$' ELSE 'gbp' END AS cur,
  CASE o_orderkey % 3 WHEN 0 THEN 'цена за МЕСЯЦ' WHEN 1 THEN 'за сутки' ELSE 'торг' END AS per,
  CASE o_orderkey % 3 WHEN 0 THEN 'Россия, Москва, ' WHEN 1 THEN 'Москва, ' ELSE '' END AS prefix FROM orders)"""
ROOMED = "CASE k WHEN 0 THEN CAST(rooms AS STRING) || '-комнатная квартира' WHEN 1 THEN 'Продаю студию' WHEN 2 THEN CAST(rooms AS STRING) || ' к. кв.' WHEN 3 THEN 'двухкомнатная' ELSE 'квартира' END"


def _said(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"WITH {SAID.replace('FROM orders', f'FROM parquet.`{d}/orders.parquet`')} SELECT *, {ROOMED} AS roomed FROM said")


@query(f"""plain:WITH {SAID} SELECT id, CASE k WHEN 0 THEN rooms WHEN 1 THEN 0 WHEN 2 THEN rooms WHEN 3 THEN 2 END AS rooms, area + 0.5 AS area, floor, floors AS floors_total,
  CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year_built, CASE k WHEN 0 THEN 'кирпично-монолитный' WHEN 1 THEN 'панельный' WHEN 2 THEN 'монолитно-каркасный' WHEN 3 THEN 'сталинский' ELSE '' END AS material,
  CASE id % 4 WHEN 0 THEN 'RUB' WHEN 1 THEN 'RUB' WHEN 2 THEN 'USD' ELSE 'GBP' END AS currency, CASE id % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'day' END AS period, 'Street ' || CAST(id AS VARCHAR) AS address FROM said""")
def text_facts(spark: SparkSession, d: str) -> DataFrame:
    """F10, F13, F16, F18 to F21."""
    t = _said(spark, d).withColumn("t", F.expr("concat(roomed, ', ', cast(area as string), ',5 м², на ', cast(floor as string), ' этаже из ', cast(floors as string))"))
    floors = tx.floors_from_text("t")
    return t.select(
        "id", tx.rooms_from_text("t").alias("rooms"), tx.area_from_text("t").alias("area"), floors["floor"].alias("floor"), floors["floors_total"].alias("floors_total"), tx.first_year(F.concat(F.lit("сдан в "), F.col("y").cast("string"), F.lit("г"))).alias("year_built"),
        tx.house_material("material").alias("material"), tx.currency("cur").alias("currency"), tx.price_period(F.lit("rent_long"), "per").alias("period"), tx.strip_city_prefix(F.concat("prefix", F.lit("Street "), F.col("id").cast("string"))).alias("address"),
    )


@query(f"""plain:WITH {SAID} SELECT id AS page_id, CASE WHEN id % 2 = 0 THEN 'Flat ' || CAST(id AS VARCHAR) ELSE '' END AS title, CASE WHEN id % 2 = 0 THEN CAST(area * 1000 AS DOUBLE) END AS price_value, CASE WHEN id % 2 = 0 THEN 'Street ' || CAST(id AS VARCHAR) || ', Town' ELSE 'Lane ' || CAST(id AS VARCHAR) END AS address_text,
  50 + floor / 1e2 AS lat, 30 + floors / 1e2 AS lon, CAST(100000 + id AS VARCHAR) AS external_id, 'Station ' || CAST(k AS VARCHAR) || ' 7 мин.' AS metro, 'панельный' AS house_material FROM said""")
def extracted_listings(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two structured blocks, and pages without any; elements five deep, with
    twelve children and of 12,000 characters."""
    block = """concat('<script type="application/ld+json">{"@type":"Organization","name":"o"}</script><script type="application/ld+json">[{"@type":"Offer","name":"Flat ', cast(id as string), '","address":{"streetAddress":"Street ', cast(id as string), '","addressLocality":"Town"},"offers":{"price":"', cast(area as string), ' 000","priceCurrency":"RUR"}}]</script>')"""
    rest = """concat('<div class="CardLocation__addressItem--x">Lane ', cast(id as string), ', </div><i data-latitude="', cast(50 + floor / 1e2 as string), '" data-longitude="', cast(30 + floors / 1e2 as string), '"></i><span class="MetroWithTime"><span><span><span><span><span>Station ', cast(k as string), '</span></span></span></span></span>', repeat('<i></i>', 12), '<span>7</span> мин.</span><div class="OfferCardFeature__text">', case when id % 97 = 0 then repeat('слово ', 2000) else '' end, '<b>панельный</b> дом</div><p>кирпичный дом</p>')"""
    html = f"concat(case when id % 2 = 0 then {block} else '' end, {rest})"
    rows = _said(spark, d).selectExpr("id as page_id", "concat('https://x.y/offer/', cast(100000 + id as string), '/') as url", f"{html} as html")
    return pages.extract_listings(rows).select("page_id", "title", "price_value", "address_text", "lat", "lon", "external_id", F.regexp_replace("metro", r"\s+", " ").alias("metro"), "house_material")


@query("plain:SELECT s_nationkey AS n, MAX(s_suppkey) AS last, COUNT(*) AS lines FROM supplier WHERE s_suppkey % 10 <> 0 GROUP BY s_nationkey")
def imported_stations(spark: SparkSession, d: str) -> DataFrame:
    """Lines with decimal commas, a rejected tenth, the last of a name winning."""
    s = star.view(spark, d, "supplier")
    key = F.col("s_suppkey")
    lines = s.select(key.alias("line"), F.concat(F.lit(" N"), F.col("s_nationkey").cast("string")).alias("_c0"), F.when(key % 10 == 0, "x").otherwise(F.concat(key.cast("string"), F.lit(",5"))).alias("_c1"), F.lit("37.5").alias("_c2"), F.lit("M").alias("_c3"))
    good, bad = io.import_stations(lines, None, ["title", "latitude", "lng", "city"])
    left = lines.join(bad.select("line"), "line", "left_anti").groupBy(F.trim("_c0").alias("name")).agg(F.count("*").alias("lines"))
    return good.join(left, "name").select(F.substr("name", F.lit(2)).cast("int").alias("n"), (F.col("lat") - 0.5).cast("long").alias("last"), "lines")


@query("plain:SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS raw_report FROM orders")
def stored_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports saved in two parts; those without an id get one."""
    folder = f"{shared_dir(spark)}/listinglab/reports-{uuid.uuid4().hex}"
    rows = star.view(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("raw_report"))
    io.save_reports(rows.where("n % 2 = 0"), folder)
    store = io.save_reports(rows.where("n % 2 <> 0"), folder)
    return store.where("id is not null").select("n", "id", "raw_report")


@query("plain:SELECT l_orderkey AS id, CAST(r AS INT) AS place, feature, contribution FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY ABS(contribution) DESC, feature) AS r FROM (SELECT l_orderkey, 'line' || CAST(l_linenumber AS VARCHAR) AS feature, MIN(ROUND(l_extendedprice - 30000, 2)) AS contribution FROM lineitem GROUP BY l_orderkey, l_linenumber) t) u WHERE r <= 3")
def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Of each order's lines and a bias."""
    rows = star.view(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.round(F.col("l_extendedprice") - 30000, 2)).cast("double").alias("contribution"))
    named = F.collect_list(F.struct(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("feature"), "contribution"))
    all_ = rows.groupBy("l_orderkey").agg(named.alias("c")).withColumn("c", F.array_append("c", F.struct(F.lit("bias").alias("feature"), F.lit(1e9).alias("contribution"))))
    return all_.select(F.col("l_orderkey").alias("id"), F.posexplode(reports.top_features(F.col("c"), 3)).alias("place", "f")).select("id", (F.col("place") + 1).alias("place"), "f.feature", "f.contribution")


ENRICHED = with_(NEAR + f", dens AS (SELECT id, COUNT(*) - 1 AS density FROM near GROUP BY id), st AS (SELECT * FROM (SELECT l.id, {metres('l.', 'm.')} AS m, m.name, ROW_NUMBER() OVER (PARTITION BY l.id ORDER BY {metres('l.', 'm.')}, m.name) AS r FROM listing l JOIN ref_metro m ON l.city = m.city WHERE l.lat IS NOT NULL AND l.lon IS NOT NULL) t WHERE r = 1)",
    f"SELECT l.id, ROUND(st.m, 3) AS dist_to_metro_m, COALESCE(l.metro_station, st.name) AS metro_station, ROUND({metres('l.lat l.lon', 'c.center_lat c.center_lon')} / 1000e0, 6) AS dist_to_center_km, dens.density AS density_500m FROM listing l LEFT JOIN st ON l.id = st.id LEFT JOIN ref_city c ON l.city = c.city LEFT JOIN dens ON l.id = dens.id")


@query(ENRICHED)
def enriched_listings(spark: SparkSession, d: str) -> DataFrame:
    """B7"""
    out = enrich.enrich(listing(spark, d), star.stations(spark, d), star.cities(spark, d))
    return out.select("id", F.round("dist_to_metro_m", 3).alias("dist_to_metro_m"), "metro_station", F.round("dist_to_center_km", 6).alias("dist_to_center_km"), "density_500m")


UPSERTED = """old AS (SELECT * REPLACE (CASE WHEN deal_type = 'sale' THEN price_rub + 1000 ELSE price_rub END AS price_rub) FROM listing WHERE last_seen < TIMESTAMP '1997-01-01'),
ups AS (SELECT s.external_id, s.price_rub, s.metro_station, CASE WHEN o.id IS NULL OR (o.price_rub, o.title) IS DISTINCT FROM (s.price_rub, s.title) THEN s.last_seen + INTERVAL 9 DAY ELSE o.last_seen END AS last_seen, CASE WHEN o.id IS NULL THEN s.first_seen + INTERVAL 9 DAY ELSE o.first_seen END AS first_seen,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN o.price_rub IS DISTINCT FROM s.price_rub THEN 'updated' ELSE 'unchanged' END AS action FROM listing s LEFT JOIN old o ON s.external_id = o.external_id AND s.deal_type = o.deal_type)"""


@query(with_(UPSERTED, "SELECT * FROM ups"))
def upserted_listings(spark: SparkSession, d: str) -> DataFrame:
    """B3's upsert: all listings, seen nine days later, over the older ones with other prices."""
    rows = listing(spark, d)
    old = rows.where("last_seen < timestamp_ntz'1997-01-01'").withColumn("price_rub", F.expr("case when deal_type = 'sale' then price_rub + 1000 else price_rub end"))
    later = {c: F.col(c) + F.expr("interval 9 days") for c in ("first_seen", "last_seen")}
    return clean.merge_listings(old, rows.withColumns(later)).select("external_id", "price_rub", "metro_station", "first_seen", "last_seen", "action")


# -- jobs ------------------------------------------------------------------------------------


@query("plain:" + CLUSTERS + f", mast AS (SELECT *, {CELL} AS cell FROM listing WHERE id NOT IN (SELECT member_id FROM cluster)) SELECT city, deal_type, COUNT(*) AS n, COUNT(DISTINCT cell) AS cells, ROUND(AVG(price_rub), 4) AS mean_price FROM mast GROUP BY city, deal_type")
def cleaning_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = run_pipeline(raw(spark, d), star.stations(spark, d), star.cities(spark, d), star.as_of())
    return rows.groupBy("city", "deal_type").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("cells"), F.round(F.avg("price_rub"), 4).alias("mean_price"))


_MODELS: dict = {}


def _model(spark: SparkSession, d: str):
    """The model, trained on the older 70% of rentals and calibrated on the others, and all
    rentals with what it reads. An application trains it, and stores them, once for each folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        numeric = ["rooms", "area_total", "area_living", "area_kitchen", "floor", "floors_total", "age_house", "dist_to_center_km", "dist_to_metro_m", "metro_walk_min", "density_500m"]
        categorical = ["deal_type", "house_material", "rooms_bucket"]
        rows = features.features(listing(spark, d).where("deal_type <> 'sale'"), star.stations(spark, d), star.cities(spark, d), star.as_of())
        rows = stored(rows.select("id", "last_seen", "price_rub", "cell", *numeric, *categorical), "rentals")  # read by the split, each part and the queries
        a, b = features.time_split(rows, "last_seen", ratio=0.3)
        _MODELS[key] = model.train(a, b, numeric, categorical), rows
    return _MODELS[key]


@query()
def price_predictions(spark: SparkSession, d: str) -> DataFrame:
    fitted, rows = _model(spark, d)
    both = model.predict(fitted, rows, interval="both")
    return both.select("id", "prediction_rub", "interval_low_rub", "interval_high_rub", "quantile_low_rub", "quantile_high_rub")


@query()
def price_explanations(spark: SparkSession, d: str) -> DataFrame:
    fitted, rows = _model(spark, d)
    out = model.explain(fitted, model.predict(fitted, rows))
    return out.select("id", "base_value", "prediction_internal", "top_features")


@query()
def requests_to_reports(spark: SparkSession, d: str) -> DataFrame:
    fitted, _ = _model(spark, d)
    caches = star.view(spark, d, "geocode_cache"), star.view(spark, d, "building_cache")
    b = star.view(spark, d, "building").withColumn("year_built", F.lit(None).cast("int"))
    out = value_requests(star.view(spark, d, "request"), *caches, b, listing(spark, d), star.stations(spark, d), star.cities(spark, d), fitted, star.as_of(), max_age_days=2000)
    return out.select("request_id", "report_id", "reject", "object", "enriched", "pricing", "explanation", F.size("comparables").alias("comps"), "text.summary_long")
