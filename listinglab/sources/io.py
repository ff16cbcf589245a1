"""Reading and writing tables."""

import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import coerce_types
from ..operators.merge import last_write, merge_upsert

# The export's columns, in its order.
EXPORT = [
    "deal_type", "city", "district", "price_rub", "price_period", "price_per_m2", "rooms", "area_total", "area_living", "area_kitchen",
    "floor", "floors_total", "year_built", "house_material", "condition", "lat", "lon", "dist_to_metro_m", "dist_to_center_km",
    "density_500m", "metro_station", "metro_walk_min", "first_seen", "last_seen",
]
# Header names of a stations file.
STATION_NAMES = {"name": "name station metro title", "lat": "lat latitude", "lon": "lon lng long longitude", "city": "city"}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, CSV or JSON file by its extension; JSON by lines, or else one array. With
    a `schema` text files are read once; without, a first pass infers one."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if kind in ("json", "ndjson", "jsonl"):
        if schema:
            return spark.read.json(path, schema=schema, multiLine=not (spark.read.text(path).first() or [""])[0].lstrip().startswith("{"))
        lines = spark.read.json(path)
        return spark.read.json(path, multiLine=True) if lines.columns in ([], ["_corrupt_record"]) or "_corrupt_record" in lines.columns else lines
    raise ValueError(f"unknown kind of table: {path}")


def write_table(df: DataFrame, path: str) -> None:
    """Parquet or CSV by the path's extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown kind of table: {path}")


def export_listings(listing: DataFrame, sql: str | None = None) -> DataFrame:
    """S3: what a SQL text gives over the view listing_master (which is there for this text
    only), or the export's columns of its active rows, null where it lacks them; types coerced,
    times in UTC."""
    if sql:
        listing.createOrReplaceTempView("listing_master")
        try:
            return coerce_types(listing.sparkSession.sql(sql))
        finally:
            listing.sparkSession.catalog.dropTempView("listing_master")
    return coerce_types(listing.where("is_active").select(*[F.col(c) if c in listing.columns else F.lit(None).cast("string").alias(c) for c in EXPORT]))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in `parts` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def copy_table(source: DataFrame, path: str | None = None, url: str | None = None, table: str | None = None, **options: str) -> int:
    """The whole table in its own column order, as Parquet at `path` or into `table` of the
    database at `url` (each partition writes its rows over its own connection); the number of
    rows copied. A database is read with `read_jdbc`, so copies go either way or directly."""
    seen = Observation("copied")
    writer = source.select(*source.columns).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    if path:
        writer.parquet(path)
    elif url and table:
        writer.format("jdbc").options(url=url, dbtable=table, **options).save()
    else:
        raise ValueError("name a path, or a database and a table")
    return seen.get["n"]


def import_stations(lines: DataFrame, default_city: str | None = None, header: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stations of a CSV read without header (_c0, _c1, ..., and `line` for the order):
    (city, name, lat, lon), the last line winning, and rejected lines with the reason. Without
    `header` the columns are name, lat, lon. Decimal commas are read as points."""
    place = {"name": 0, "lat": 1, "lon": 2, "city": None}
    if header:
        keys = [h.strip().lower() for h in header]
        place = {k: next((i for i, h in enumerate(keys) if h in names.split()), None) for k, names in STATION_NAMES.items()}
        if any(place[k] is None for k in ("name", "lat", "lon")):
            raise ValueError("the header must name columns for name, lat and lon")
    cell = lambda k: F.trim(F.col(f"_c{place[k]}")) if place[k] is not None and f"_c{place[k]}" in lines.columns else F.lit(None).cast("string")
    num = lambda k: F.regexp_replace(cell(k), ",", ".").try_cast("double")
    city = F.coalesce(F.nullif(cell("city"), F.lit("")), F.nullif(F.lit(default_city or ""), F.lit("")))
    rows = lines.select("line", city.alias("city"), F.coalesce(cell("name"), F.lit("")).alias("name"), num("lat").alias("lat"), num("lon").alias("lon"), cell("lat").isNull().alias("_a"), cell("lon").isNull().alias("_b"))
    reason = F.when(F.col("_a") | F.col("_b"), "short row").when(F.col("name") == "", "empty name").when(F.col("lat").isNull() | F.col("lon").isNull(), "bad coordinates").when(F.col("city").isNull(), "no city")
    rows = rows.withColumn("reason", reason).drop("_a", "_b")
    good = last_write(rows.where("reason is null").drop("reason"), ["city", "name"], ["line"])
    return good.drop("line"), rows.where("reason is not null")


def read_stations(spark: SparkSession, path: str, default_city: str | None = None, sep: str = ",", dry_run: bool = False) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(stations or None if `dry_run`, rejects, summary) of a stations file. Its
    first line is a header if it holds name, lat, lon or city."""
    first = (spark.read.text(path).first() or [""])[0].lower()
    names = [x.strip().strip('"') for x in first.split(sep)] if any(k in first for k in ("name", "lat", "lon", "city")) and first.count(sep) >= 2 else None
    raw = spark.read.csv(path, sep=sep, header=False)
    lines = raw.withColumn("line", F.monotonically_increasing_id())
    if names:
        cells = [F.lower(F.trim(f"_c{i}")) for i in range(len(names))]
        lines = lines.where(~F.array(*cells).eqNullSafe(F.array(*[F.lit(n) for n in names])))
    good, bad = import_stations(lines, default_city, names)
    summary = lines.agg(F.count("*").alias("total")).crossJoin(good.agg(F.count("*").alias("affected"))).crossJoin(bad.agg(F.count_if(F.col("reason") == "short row").alias("skipped"), F.count_if(F.col("reason") != "short row").alias("errors")))  # one row each
    return None if dry_run else good, bad, summary


def upsert_raw(raw: DataFrame, batch: DataFrame, ingested_at: Column) -> DataFrame:
    """Raw listings after a batch, all its columns overwriting (nulls too), the last row
    of a key winning, with the time of arrival as `ingested_at` of the object in `payload` (of
    its own, if that is null or no object), and `action`."""
    keys = ["source", "deal_type", "external_id"]
    fresh = last_write(batch, keys, ["collected_at"])
    rest = [c for c in raw.columns if c not in keys]
    missing = [c for c in rest if c not in fresh.columns]
    fresh = fresh.withColumns({c: F.lit(None).cast(raw.schema[c].dataType) for c in missing})
    if "payload" in rest:
        own = F.from_json("payload", "map<string,variant>")
        own = F.map_filter(F.coalesce(own, F.expr("cast(map() as map<string,variant>)")), lambda k, _: k != "ingested_at")
        arrival = F.parse_json(F.to_json(F.struct(ingested_at.cast("string").alias("t"))))
        fresh = fresh.withColumn("payload", F.to_json(F.map_concat(own, F.create_map(F.lit("ingested_at"), F.variant_get(arrival, "$.t", "variant")))))
    return merge_upsert(raw, fresh, keys, rest, touch_unchanged=True)


def _shard(id_: Column) -> Column:
    return F.concat(F.lit("s"), F.substring(F.md5(id_), 1, 2))


def save_reports(reports: DataFrame, path: str) -> DataFrame:
    """Appended to the store, which is parted by the first byte of a hash of the id, with a
    bloom filter of ids in each file. A report without id gets one from its content, so that a
    job that runs again gives the same."""
    rest = F.to_json(F.struct(*[c for c in reports.columns if c != "id"]))
    named = reports.withColumn("id", F.coalesce(F.col("id"), F.substring(F.sha2(rest, 256), 1, 32))).withColumn("shard", _shard(F.col("id")))
    out = named.repartition("shard").write.mode("append").partitionBy("shard")
    out.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", "100000").parquet(path)
    return named.sparkSession.read.parquet(path)


def get_report(store: DataFrame, id_: str) -> DataFrame:
    """The report of that id, or no row. Only its shard is read, and of that only files
    whose bloom filter knows the id."""
    if "shard" not in store.columns:
        return store.where(F.col("id") == id_)
    shard = "s" + hashlib.md5(id_.encode(), usedforsecurity=False).hexdigest()[:2]
    return store.where((F.col("shard") == shard) & (F.col("id") == id_)).drop("shard")
