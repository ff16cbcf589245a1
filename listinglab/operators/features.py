"""Training features: local price statistics, imputation, time split."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from .enrich import center_distance_km, density, nearest_station, recent
from .stats import quantiles


def features(listing: DataFrame, stations: DataFrame, cities: DataFrame, as_of: Column, radius_m: float = 500.0) -> DataFrame:
    """Listings with distances, walking minutes, density of listings seen in 90 days, age
    of the house, price of a square metre and grid cell; what was enriched before is replaced."""
    base = listing.drop("dist_to_metro_m", "metro_station", "metro_walk_min", "dist_to_center_km", "density_500m")
    near = nearest_station(base, stations)
    dense = density(base, recent(listing, as_of), radius_m)
    out = center_distance_km(base, cities).join(near, "id", "left").join(dense, "id", "left")
    return out.withColumns({
        "metro_walk_min": geo.walk_min("dist_m"),
        "age_house": tx.house_age("year_built", as_of),
        "price_per_m2_calc": tx.price_per_m2_calc("price_rub", "area_total"),
        "cell": geo.cell("lat", "lon"),
        "rooms_bucket": tx.rooms_bucket("rooms"),
    }).withColumnsRenamed({"dist_m": "dist_to_metro_m", "station": "metro_station", "center_km": "dist_to_center_km", "density": "density_500m"})


def local_stats(rows: DataFrame) -> DataFrame:
    """A1: sum and count of prices by cell and rooms bucket; rows without a cell are left out."""
    return rows.where("cell is not null and rooms_bucket is not null and price_rub is not null").groupBy("cell", "rooms_bucket").agg(F.sum("price_rub").alias("price_sum"), F.count("*").alias("price_n"))


def global_mean(rows: DataFrame) -> DataFrame:
    """A2: one row."""
    return rows.agg(F.avg("price_rub").alias("global_mean"))


def with_local_price(rows: DataFrame, stats: DataFrame, mean: DataFrame) -> DataFrame:
    """local_avg_price_rub and local_density_count from the statistics, or the global mean
    and 0."""
    s = rows.join(stats, ["cell", "rooms_bucket"], "left").crossJoin(F.broadcast(mean))  # mean: one row
    return s.withColumns({"local_avg_price_rub": F.coalesce(F.col("price_sum") / F.col("price_n"), "global_mean"), "local_density_count": F.coalesce("price_n", F.lit(0))}).drop("price_sum", "price_n", "global_mean")


def leave_one_out(rows: DataFrame) -> DataFrame:
    """A3: each row's local mean without itself, or the global mean if it is alone; its own
    row counts in local_density_count. The sums come from an aggregate that is joined back, so
    no window gathers a cell."""
    stats, mean = local_stats(rows), F.broadcast(global_mean(rows))  # mean: one row
    out = rows.join(stats, ["cell", "rooms_bucket"], "left").crossJoin(mean)
    alone = F.coalesce(F.col("price_n") - 1 <= 0, F.lit(True)) | F.col("price_rub").isNull()
    loo = F.when(alone, F.col("global_mean")).otherwise((F.col("price_sum") - F.col("price_rub")) / (F.col("price_n") - 1))
    return out.withColumns({"local_avg_price_rub": loo, "local_density_count": F.coalesce("price_n", F.lit(0))}).drop("price_sum", "price_n", "global_mean")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value) of each column's most frequent value, nulls counted, the smallest on
    ties (null first)."""
    long_ = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    n = long_.groupBy("name", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "value", "n")


def impute(df: DataFrame, numbers: dict, categories: dict) -> DataFrame:
    """Nulls filled from stored statistics; what has none becomes 0 or empty."""
    fill = {c: F.coalesce(F.col(c), F.lit(v if v is not None else 0.0)) for c, v in numbers.items() if c in df.columns}
    fill |= {c: F.coalesce(F.col(c), F.lit(v if v is not None else "")) for c, v in categories.items() if c in df.columns}
    return df.withColumns(fill)


def time_split(df: DataFrame, column: str, days: int = 30, ratio: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by a cutoff time: rows up to it train. The cutoff is the quantile
    1 - `ratio`, or the latest time less `days`. Rows without a time are in neither."""
    if ratio is not None and not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    known = df.where(F.col(column).isNotNull())
    if ratio is None:
        latest = df.agg(F.max(micros)).first()[0]
        cut = None if latest is None else latest - days * 86_400_000_000
    else:
        cut = quantiles(df, {"t": micros}, [1 - ratio])["t"][0]
    both = known.withColumn("_train", micros <= F.lit(cut).cast("double"))
    return both.where("_train").drop("_train"), both.where("not _train").drop("_train")
