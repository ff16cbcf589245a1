"""Listing tables over the star tables: the same text in Spark SQL and DuckDB."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "region nation customer supplier part orders lineitem events pages".split()
AS_OF = "2001-08-02 00:00:00"

VIEWS = {
    "ref_city": """
SELECT n_nationkey, n_name AS city,
       4e1 + (n_nationkey % 5) * 3e0 AS center_lat,
       1e1 + CAST(FLOOR(n_nationkey / 5e0) AS INT) * 5e0 AS center_lon
FROM nation""",
    "ref_metro": """
SELECT s.s_suppkey AS id, c.city, s.s_name AS name,
       c.center_lat + (((s.s_suppkey * 7919) % 1009) / 1009e0 - 5e-1) * 18e-2 AS lat,
       c.center_lon + (((s.s_suppkey * 104729) % 1013) / 1013e0 - 5e-1) * 24e-2 AS lon
FROM supplier s JOIN ref_city c ON s.s_nationkey = c.n_nationkey""",
    "listing_raw": """
SELECT o.o_orderkey AS id, 'star' AS source,
       CASE o.o_orderstatus WHEN 'F' THEN 'rent_long' WHEN 'O' THEN 'sale' ELSE 'rent_daily' END AS deal_type,
       CAST(o.o_orderkey AS STRING) AS external_id,
       CONCAT('https://example.org/offer/', CAST(100000 + o.o_orderkey AS STRING), '/') AS url,
       CONCAT('  Flat   ', CAST(o.o_orderkey AS STRING), ' ') AS title,
       o.o_orderpriority AS condition,
       CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE 2e4 + FLOOR(o.o_totalprice / 1e4) * 5e2 END AS price_value,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderkey % 4 AS INT) END AS rooms,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE 25e0 + (o.o_orderkey % 8) * 6e0 END AS area_total,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE 2e1 + (o.o_orderkey % 10) * 5e0 END AS area_living,
       CAST(1 + o.o_orderkey % 9 AS INT) AS floor,
       CAST(5 + c.c_custkey % 12 AS INT) AS floors_total,
       CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE CAST(1950 + c.c_custkey % 75 AS INT) END AS year_built,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'кирпичный' WHEN 'MACHINERY' THEN 'монолитный' WHEN 'FURNITURE' THEN 'панельный' WHEN 'HOUSEHOLD' THEN 'монолитно-каркасный' ELSE NULL END AS house_material,
       CONCAT('  Street  ', CAST(c.c_custkey AS STRING), ' ') AS address_text,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CONCAT(' Near  ', c.c_name, '  ') END AS description,
       CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE CONCAT('District ', CAST(c.c_custkey % 12 AS STRING)) END AS district,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE 6e0 + (o.o_orderkey % 5) * 15e-1 END AS area_kitchen,
       CASE o.o_orderkey % 6 WHEN 0 THEN NULL
            WHEN 1 THEN CONCAT('Парк  ', CAST(o.o_orderkey % 40 AS STRING), ' • ', CAST(o.o_orderkey % 25 AS STRING), ' мин.')
            WHEN 2 THEN CONCAT(' Мост-', CAST(c.c_custkey % 40 AS STRING), ', 7 мин пешком')
            WHEN 3 THEN CONCAT('Площадь ', CAST(c.c_custkey % 40 AS STRING), ' - , центр')
            WHEN 4 THEN '12 мин' ELSE '  ' END AS metro,
       CASE WHEN o.o_orderkey % 4 = 0 THEN CONCAT('Central ', CAST(c.c_custkey % 7 AS STRING)) END AS metro_station,
       CONCAT('{"clerk":"', c.c_name, '","ingested_at":"old"}') AS payload,
       k.city, o.o_orderdate AS collected_at,
       CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE k.center_lat + (((c.c_custkey * 7919) % 10007) / 10007e0 - 5e-1) * 18e-2 + (o.o_orderkey % 3) * 2e-4 END AS lat,
       CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE k.center_lon + (((c.c_custkey * 104729) % 10009) / 10009e0 - 5e-1) * 24e-2 END AS lon
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN ref_city k ON c.c_nationkey = k.n_nationkey""",
    "price_obs": """
SELECT l_orderkey AS listing_id, l_shipdate AS ts, l_linenumber AS seq, MAX(FLOOR(l_extendedprice / 25e3) * 25e3) AS price_rub
FROM lineitem GROUP BY l_orderkey, l_shipdate, l_linenumber""",
    "geocode_cache": """
SELECT k.city, CONCAT('street ', CAST(c.c_custkey AS STRING)) AS address_norm,
       k.center_lat + (c.c_custkey % 97) * 1e-3 AS lat, k.center_lon - (c.c_custkey % 89) * 1e-3 AS lon,
       MAX(o.o_orderdate) AS created_at
FROM customer c JOIN ref_city k ON c.c_nationkey = k.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment <> 'AUTOMOBILE'
GROUP BY k.city, c.c_custkey, k.center_lat, k.center_lon""",
    "building": """
SELECT c.c_custkey AS building_id, k.city,
       k.center_lat + (((c.c_custkey * 7919) % 10007) / 10007e0 - 5e-1) * 18e-2 + 1e-4 AS lat,
       k.center_lon + (((c.c_custkey * 104729) % 10009) / 10009e0 - 5e-1) * 24e-2 AS lon,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE CAST(5 + c.c_custkey % 12 AS INT) END AS floors_total,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'c. 1987' WHEN c.c_custkey % 3 = 1 THEN '2004-05-01' ELSE NULL END AS start_date,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'brick' ELSE NULL END AS house_material
FROM customer c JOIN ref_city k ON c.c_nationkey = k.n_nationkey""",
    "request": """
SELECT c.c_custkey AS request_id, k.city, CONCAT('Street ', CAST(c.c_custkey AS STRING)) AS address,
       CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE k.center_lat + (((c.c_custkey * 7919) % 10007) / 10007e0 - 5e-1) * 18e-2 END AS lat,
       CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE k.center_lon + (((c.c_custkey * 104729) % 10009) / 10009e0 - 5e-1) * 24e-2 END AS lon,
       CASE WHEN c.c_custkey % 60 = 0 THEN NULL ELSE CAST(c.c_custkey % 4 AS INT) END AS rooms,
       30e0 + (c.c_custkey % 6) * 1e1 AS area_total
FROM customer c JOIN ref_city k ON c.c_nationkey = k.n_nationkey""",
    "geocode_candidate": """
SELECT r.request_id, s.s_suppkey AS pos,
       CASE WHEN s.s_suppkey % 3 = 0 THEN r.city ELSE 'elsewhere' END AS cand_city,
       k.center_lat + (s.s_suppkey % 37) * 1e-3 AS lat, k.center_lon + (s.s_suppkey % 41) * 1e-3 AS lon
FROM request r JOIN ref_city k ON r.city = k.city JOIN supplier s ON s.s_nationkey = k.n_nationkey
WHERE r.lat IS NULL""",
    "building_cache": """
SELECT k.city, CONCAT('street ', CAST(c.c_custkey AS STRING)) AS address_norm, k.center_lat AS lat, k.center_lon AS lon,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 0 ELSE CAST(3 + c.c_custkey % 9 AS INT) END AS floors_total,
       CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE CAST(1960 + c.c_custkey % 50 AS INT) END AS year_built,
       CASE WHEN c.c_mktsegment = 'FURNITURE' THEN '' ELSE 'cached' END AS house_material,
       o.o_orderdate AS created_at
FROM customer c JOIN ref_city k ON c.c_nationkey = k.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_acctbal < 3000""",
}


def with_views(query: str) -> str:
    """A query with the listing views in front, for DuckDB."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + "\n" + query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a star table, over the tables of `sf_dir`."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in ("nation", "customer", "supplier", "orders", "lineitem")]
    return spark.sql("WITH " + ",\n".join([*base, *(f"{k} AS ({v})" for k, v in VIEWS.items())]) + f"\nSELECT * FROM {name}")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ref_city")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ref_metro")
