"""Valuation requests and reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from .comps import as_array, comparables
from .enrich import center_distance_km, density, nearest_station, recent
from .geocode import fill_building, fill_points


def resolve_requests(requests: DataFrame, cache: DataFrame, buildings: DataFrame, overrides: DataFrame | None = None, building_cache: DataFrame | None = None, as_of: Column | None = None, max_age_days: float | None = 365) -> tuple[DataFrame, DataFrame]:
    """(requests with points and building facts filled, new rows for the building cache).

    `reject` says why a request can't be valued (no rooms, no area, no address and no point, no
    point found), or is null. `overrides` (request_id and columns) replace a request's own
    values where not null. Both caches hold for `max_age_days` before `as_of`, if that is given."""
    r = requests
    if overrides is not None:
        o = overrides.withColumnsRenamed({c: f"_o_{c}" for c in overrides.columns if c != "request_id"})
        r = r.join(o, "request_id", "left")
        r = r.withColumns({c: F.coalesce(f"_o_{c}", c) for c in overrides.columns if c != "request_id"}).drop(*[c for c in r.columns if c.startswith("_o_")])
    for c, kind in (("floors_total", "int"), ("year_built", "int"), ("house_material", "string")):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(kind))
    placed = fill_points(r, cache, F.col("address"), as_of, max_age_days if as_of is not None else None)
    filled, new = fill_building(placed, buildings, building_cache, id_="request_id", address="address", as_of=as_of, max_age_days=max_age_days)
    none = lambda c: F.col(c).isNull()
    reject = F.when(none("rooms"), "rooms").when(none("area_total"), "area_total").when((F.coalesce(tx.trimmed("address"), F.lit("")) == "") & (none("lat") | none("lon")), "address").when(none("lat") | none("lon"), "not found")
    return filled.withColumn("reject", reject), new


def report_features(requests: DataFrame, stations: DataFrame, cities: DataFrame, listing: DataFrame, as_of: Column) -> DataFrame:
    """B9 for requests, which have no price of their own."""
    near = nearest_station(requests, stations, "request_id")
    dense = density(requests, recent(listing, as_of), 500.0, "request_id")
    out = center_distance_km(requests, cities).join(near, "request_id", "left").join(dense, "request_id", "left")
    out = out.withColumns({"metro_walk_min": geo.walk_min("dist_m"), "age_house": tx.house_age("year_built", as_of), "cell": geo.cell("lat", "lon"), "rooms_bucket": tx.rooms_bucket("rooms")})
    return out.withColumnsRenamed({"dist_m": "dist_to_metro_m", "station": "metro_station", "center_km": "dist_to_center_km", "density": "density_500m"})


# The fields of a report's parts, with their types.
OBJECT = {
    "address": "string", "city": "string", "rooms": "int", "area_total": "double", "area_living": "double", "area_kitchen": "double",
    "floor": "int", "floors_total": "int", "year_built": "int", "house_material": "string", "condition": "string",
}
ENRICHED = {
    "lat": "double", "lon": "double", "dist_to_center_km": "double", "metro_station": "string", "dist_to_metro_m": "double",
    "metro_walk_min": "int", "density_500m": "long",
}
PRICING = ["prediction_rub", "interval_low_rub", "interval_high_rub", "currency", "deal_type"]
MODEL_INFO = {"model_name": "string", "target": "string", "log_target": "boolean", "valid_mae": "double", "valid_rmse": "double", "valid_mape": "double"}
_FEATURES = "array<struct<feature: string, contribution: double>>"


def valuation_reports(requests: DataFrame, predictions: DataFrame, listing: DataFrame, explanations: DataFrame | None = None, k: int = 5, radius_km: float = 3.0, model_info: dict | None = None, generated_at: Column | None = None) -> DataFrame:
    """One nested report a request: report_id, generated_at, version, object, enriched,
    pricing, comparables, explanation, model_info, text; fields that `requests` lacks are null.

    `predictions` has request_id, prediction_rub, interval_low_rub, interval_high_rub;
    `explanations` request_id, base_value, prediction_internal, top_features; `model_info` the
    model's name, target and errors. The id is a hash of request and time, so that a repeated
    run gives the same reports."""
    comps = as_array(comparables(requests, listing, k, radius_km))
    r = requests.join(predictions, "request_id", "left").join(comps, "request_id", "left")
    if explanations is None:
        r = r.withColumns({"base_value": F.lit(None).cast("double"), "prediction_internal": F.lit(None).cast("double"), "top_features": F.expr(f"cast(array() as {_FEATURES})")})
    else:
        r = r.join(explanations.select("request_id", "base_value", "prediction_internal", "top_features"), "request_id", "left")
    has = lambda c, kind: (F.col(c).cast(kind) if c in requests.columns else F.lit(None).cast(kind)).alias(c)
    part = lambda fields: F.struct(*[has(c, kind) for c, kind in fields.items()])
    text = tx.text_blocks(F.col("city"), F.col("address"), F.col("area_total"), has("floor", "int"), has("metro_walk_min", "int"), F.col("prediction_rub"), F.col("interval_low_rub"), F.col("interval_high_rub"), F.coalesce("top_features", F.expr(f"cast(array() as {_FEATURES})")))
    when = (generated_at if generated_at is not None else F.lit(None)).cast("string")
    h = F.md5(F.concat_ws("|", F.lit("report"), F.col("request_id").cast("string"), when).cast("binary"))
    id_ = F.concat_ws("-", *[F.substr(h, F.lit(i), F.lit(n)) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    info = model_info or {}
    return r.select(
        "request_id",
        id_.alias("report_id"),
        when.alias("generated_at"),
        F.lit("listinglab_report_v1").alias("version"),
        part(OBJECT).alias("object"),
        part(ENRICHED).alias("enriched"),
        F.struct("prediction_rub", "interval_low_rub", "interval_high_rub", F.lit("RUB").alias("currency"), F.lit("rent_long").alias("deal_type")).alias("pricing"),
        "comparables",
        F.struct("base_value", "prediction_internal", "top_features").alias("explanation"),
        F.struct(*[F.lit(info.get(c)).cast(kind).alias(c) for c, kind in MODEL_INFO.items()]).alias("model_info"),
        text.alias("text"),
    )


def _fields(of: Column, names: list[str]) -> Column:
    return F.struct(*[of[n].alias(n) for n in names])


def thin(reports: DataFrame) -> DataFrame:
    """report_id, the object's main fields, price, text and the first three comparables."""
    facts = ["price_rub", "rooms", "area_total", "distance_km", "metro_station", "url"]
    return reports.select(
        "request_id",
        "report_id",
        _fields(F.col("object"), ["city", "address", "rooms", "area_total", "floor", "floors_total", "year_built", "house_material"]).alias("object"),
        _fields(F.col("pricing"), PRICING).alias("price"),
        _fields(F.col("text"), ["summary_short", "summary_long", "factors_summary"]).alias("text"),
        F.transform(F.slice("comparables", 1, 3), lambda c: _fields(c, facts)).alias("comparables"),
    )


def compact(reports: DataFrame) -> DataFrame:
    """(request_id, payload): JSON of object, geo, pricing, top features and the first five
    comparables by nine facts each."""
    same = ["price_rub", "rooms", "area_total", "floor", "floors_total", "year_built", "house_material"]
    comps = F.transform(F.slice("comparables", 1, 5), lambda c: F.struct(*[c[n].alias(n) for n in same], c["distance_km"].alias("dist_km"), c["metro_station"].alias("metro")))
    empty = F.expr(f"cast(array() as {_FEATURES})")
    body = F.struct(F.col("object"), F.col("enriched").alias("geo"), F.col("pricing"), F.coalesce("explanation.top_features", empty).alias("explanation_top_features"), F.coalesce(comps, F.array()).alias("comparables"))
    return reports.select("request_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def top_features(contributions: Column, n: int = 8) -> Column:
    """The `n` contributions of greatest size, without the bias; ties by name."""
    named = F.filter(contributions, lambda c: c["feature"] != "bias")
    keyed = F.transform(named, lambda c: F.struct((-F.abs(c["contribution"])).alias("k"), c["feature"].alias("feature"), c["contribution"].alias("contribution")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution")))


def list_reports(store: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Stored reports, the newest first, ties by id; limits up to 0 mean 20, negative
    offsets 0. The short text comes out of the stored JSON."""
    page = store.orderBy(F.desc("created_at"), "id").offset(max(offset, 0)).limit(limit if limit > 0 else 20)
    return page.withColumn("summary_short", F.get_json_object("raw_report", "$.text.summary_short")).drop("raw_report")
