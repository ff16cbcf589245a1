"""Jobs from raw listings to training tables, and from requests to reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean, dedupe, enrich, features, model, reports
from ..sources.io import export_listings
from ..sources.shared import dropped, stored


def run_pipeline(raw: DataFrame, stations: DataFrame, cities: DataFrame, as_of: Column) -> DataFrame:
    """B18, first half: normalised, enriched, without duplicates, with features. What enrich
    gives is stored once, as three later steps read it."""
    listing = stored(enrich.enrich(clean.normalize(raw), stations, cities), "listing")
    masters = clean.masters(listing, dedupe.clusters(listing, as_of))
    return features.features(masters, stations, cities, as_of)


def training_tables(masters: DataFrame, deal_type: str = "rent_long", ratio: float | None = None, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B18, second half: (export, train, valid) of masters with features: the export's columns
    of active rows, and the rows of one deal type split by time."""
    train, valid = features.time_split(masters.where(F.col("deal_type") == deal_type), "last_seen", days, ratio)
    return export_listings(masters), train, valid


def value_requests(requests: DataFrame, geocode_cache: DataFrame, building_cache: DataFrame, buildings: DataFrame, listing: DataFrame, stations: DataFrame, cities: DataFrame, fitted: model.PriceModel, as_of: Column, max_age_days: float | None = 365, k: int = 5, radius_km: float = 3.0) -> DataFrame:
    """B17, B9, B12, B15, B14 and B16 as one job: a report for each request, and `reject` for
    those that can't be valued (which have no prices)."""
    known, _ = reports.resolve_requests(requests, geocode_cache, buildings, building_cache=building_cache, as_of=as_of, max_age_days=max_age_days)
    placed = stored(known, "placed")  # four parts of the next plan read it, and each would hold all of its joins
    known = stored(reports.report_features(placed, stations, cities, listing, as_of), "requests")
    dropped(placed)
    rows = known.where("reject is null")
    told = model.explain(fitted, model.predict(fitted, rows))
    told = stored(told.select("request_id", "prediction_rub", "interval_low_rub", "interval_high_rub", "base_value", "prediction_internal", "top_features"), "valued")
    info = {"model_name": "gradient-boosted trees", "target": "price_rub", "log_target": True} | {f"valid_{m}": fitted.metrics.get(m) for m in ("mae", "rmse", "mape")}
    out = reports.valuation_reports(known, told.select("request_id", "prediction_rub", "interval_low_rub", "interval_high_rub"), listing, told, k, radius_km, info, as_of)
    return out.join(known.select("request_id", "reject"), "request_id")
