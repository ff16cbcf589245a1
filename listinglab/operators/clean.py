"""Cleaning: types, the raw to clean listing step, filters, ageing out."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Columns that are numbers, times, and those that no model may see.
NUMERIC = [
    "price_rub", "price_per_m2", "rooms", "area_total", "area_living", "area_kitchen", "floor", "floors_total", "year_built",
    "lat", "lon", "dist_to_metro_m", "dist_to_center_km", "metro_walk_min", "density_500m",
]
TIMES = ["first_seen", "last_seen", "created_at", "updated_at"]
LEAKAGE = [
    "id", "url", "title", "description", "address_norm", "first_seen", "last_seen", "created_at", "updated_at",
    "geom", "contact_phone_hash", "price_per_m2", "price_per_m2_calc",
]
KEY = ["source", "deal_type", "external_id"]
# Days without a sighting after which a deal type ages out.
AGE_DAYS = {"rent_long": 250, "sale": 300}


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers as double, times as timestamps (those without a zone are UTC), is_active as
    boolean; what can't be read is null, absent columns are skipped."""
    out = {c: F.col(c).try_cast("double") for c in NUMERIC if c in df.columns}
    for c, kind in df.dtypes:
        if c in TIMES and kind != "timestamp":
            t = F.trim(F.col(c).cast("string"))
            out[c] = F.coalesce(F.concat(t, F.lit("Z")).try_cast("timestamp"), F.concat(t, F.lit("T00:00:00Z")).try_cast("timestamp"), t.try_cast("timestamp"))
    if "is_active" in df.columns:
        t = F.lower(F.col("is_active").cast("string"))
        out["is_active"] = F.when(t == "true", True).when(t == "false", False)
    return df.withColumns(out)


def normalize(raw: DataFrame, default_city: str = "", daily_days: float = 30.0) -> DataFrame:
    """B3 (P2 to P4, F1 to F5): clean listings of raw ones, in one projection.

    Rows without rooms or year are left out. Where there is a price and a positive area, rows
    above their house's floors are left out too, and a living area above the total is null.
    Station and walking minutes come from the metro text, else the station that was stored; 0
    minutes are null. A missing district is empty; columns that `raw` lacks are null."""
    has = lambda c, kind: F.col(c) if c in raw.columns else F.lit(None).cast(kind)
    text = lambda c: tx.empty_to_null(has(c, "string")).alias(c)
    priced = F.coalesce(F.col("price_value").isNotNull() & (F.col("area_total") > 0), F.lit(False))
    too_high = F.coalesce(priced & (F.col("floor") > F.col("floors_total")), F.lit(False))
    price = F.round(tx.monthly_price("deal_type", "price_value", daily_days), 2)
    living = F.when(priced & (has("area_living", "double") > F.col("area_total")), None).otherwise(has("area_living", "double"))
    known = raw.where("rooms is not null and year_built is not null").where(~too_high)
    # texts that are looked at several times are computed once, below
    known = known.withColumn("_metro_text", tx.metro_text(F.coalesce(has("metro", "string"), F.lit("")))).withColumn("_metro", tx.parse_metro("_metro_text", ready=True))
    metro = F.col("_metro")
    return known.select(
        "id", *KEY, "url", text("title"), text("description"), price.alias("price_rub"), tx.period("deal_type").alias("price_period"), tx.price_per_m2(price, "area_total").alias("price_per_m2"),
        "rooms", "area_total", living.alias("area_living"), has("area_kitchen", "double").alias("area_kitchen"), "floor", "floors_total", "year_built", text("house_material"), text("condition"),
        tx.empty_to_null("address_text").alias("address_norm"), F.coalesce(F.nullif(has("city", "string"), F.lit("")), F.lit(default_city)).alias("city"), F.coalesce(has("district", "string"), F.lit("")).alias("district"),
        text("metro"), tx.empty_to_null(tx.station(metro["station"], has("metro_station", "string"))).alias("metro_station"), F.nullif(metro["walk_min"], F.lit(0)).alias("metro_walk_min"),
        F.lit(None).cast("string").alias("contact_phone_hash"), F.lit(True).alias("is_active"), F.col("collected_at").alias("first_seen"), F.col("collected_at").alias("last_seen"), "lat", "lon",
    )


def merge_listings(listing: DataFrame, batch: DataFrame, touch_unchanged: bool = False) -> DataFrame:
    """B3's upsert: see `merge_upsert`; last_seen and is_active move only with a change unless
    `touch_unchanged`."""
    from .merge import merge_upsert

    fixed, touch = [*KEY, "id", "first_seen"], ["last_seen", "is_active"]
    return merge_upsert(listing, batch, KEY, [c for c in listing.columns if c not in (*fixed, *touch)], ["id", "first_seen"], touch, touch_unchanged)


def in_target_range(df: DataFrame, low: float = 10_000, high: float = 600_000) -> DataFrame:
    """P5: prices from `low` to `high`."""
    return df.where(F.col("price_rub").between(low, high))


def active(df: DataFrame, deal_type: str, columns: Sequence[str]) -> DataFrame:
    """P6"""
    return df.where(F.col("is_active") & (F.col("deal_type") == deal_type)).select(*columns)


def training_columns(df: DataFrame, target: str = "price_rub") -> tuple[list[str], list[str]]:
    """Numeric and categorical (text) columns that may be trained on; others are neither."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in (*LEAKAGE, target)}
    numeric = [c for c, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")]
    return numeric, [c for c, k in kinds.items() if k == "string"]


def align_to_schema(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Exactly these columns: missing numbers null, missing categories empty, categories
    that weren't strings empty where null."""
    kinds = dict(df.dtypes)
    num = [F.col(c).try_cast("double").alias(c) if c in kinds else F.lit(None).cast("double").alias(c) for c in numeric]
    text = lambda c: F.col(c) if kinds[c] == "string" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*[c for c in df.columns if c not in (*numeric, *categorical)], *num, *[text(c).alias(c) if c in kinds else F.lit("").alias(c) for c in categorical])


def without_point(df: DataFrame) -> DataFrame:
    """Rows to be geocoded."""
    return df.where("(lat is null or lon is null) and address_norm is not null")


def fresh(created_at: Column | str, as_of: Column, max_age_days: float | None) -> Column:
    """P10: whether a cache row is still valid; no limit, always."""
    c = F.col(created_at) if isinstance(created_at, str) else created_at
    return F.lit(True) if max_age_days is None else as_of - c <= F.expr(f"interval {max_age_days} days")


def deactivate(listing: DataFrame, as_of: Column) -> DataFrame:
    """Active rows not seen for their deal type's days become inactive."""
    old = F.lit(False)
    for deal, days in AGE_DAYS.items():
        old = old | ((F.col("deal_type") == deal) & (F.col("last_seen") < as_of - F.expr(f"interval {days} days")))
    return listing.withColumn("is_active", F.when(F.coalesce(old, F.lit(False)), False).otherwise(F.col("is_active")))


def is_detail_link(url: Column | str, pattern: str = r"/offer/[0-9]+") -> Column:
    """Whether a link leads to one offer."""
    u = F.col(url) if isinstance(url, str) else url
    return u.rlike(f"{pattern}([/?#]|$)")


def first_in_order(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows."""
    return df.orderBy(*order).limit(n)


def masters(listing: DataFrame, clusters: DataFrame) -> DataFrame:
    """Listings that no cluster has as a member."""
    return listing.join(clusters.select(F.col("member_id").alias("id")), "id", "left_anti")
