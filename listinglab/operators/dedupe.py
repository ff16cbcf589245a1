"""Fuzzy de-duplication of listings: candidates, scores, clusters, survivors."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..sources.shared import dropped, stored
from .components import connected_components

_SCORED = ["price_rub", "area_total", "floor", "year_built", "house_material"]


def _bands(value: Column, reach: float) -> tuple[Column, Column]:
    """The band of a number, of four reaches' width, and the one or two bands in its reach."""
    width, more = 4 * reach, reach + 1e-9
    of = lambda x: F.floor(x / width).cast("long")
    return of(value), F.array_distinct(F.array(of(value - more), of(value + more)))


def candidate_pairs(listing: DataFrame, radius_m: float = 50.0, max_area: float = 2.0, max_price: float = 0.05, max_pairs: int | None = None, metres: geo.Metres = geo.distance_m) -> DataFrame:
    """Pairs a < b of active listings of one city and deal type within the radius, rooms
    equal or both null, areas at most `max_area` apart, and prices missing or both positive
    and at most the share `max_price` of the greater apart. Columns come as l_ and r_.
    `max_pairs`, if wanted, keeps the first by (a, b); metres: on the sphere, or `geo.spheroid_m`.

    Rooms, bands of area and bands of the price's logarithm make up a join key with the cell, so a
    house of many unlike listings is no dense cell. A priced listing stands at its own key and
    looks at the keys in its reach that hash no lower than its own: of two listings one looks at
    the other, or both are at one key. One without a price looks at all in its reach, where each
    listing stands once more. So each pair meets once, and a listing is shuffled in about three
    rows that look and two that stand."""
    any_ = F.lit(-(1 << 41))
    cols = ["id", "city", "deal_type", "lat", "lon", "rooms", *_SCORED]
    rows = listing.where("is_active and area_total is not null and city is not null and deal_type is not null").where(geo.has_point("lat", "lon")).select(*cols)
    area, areas = _bands(F.col("area_total"), max_area)
    price, prices = _bands(F.ln(F.when(F.col("price_rub") > 0, F.col("price_rub"))), -math.log(1 - max_price))
    reach = radius_m * (1.0 if metres is geo.distance_m else 1.006)
    key = F.xxhash64("city", "deal_type", "rooms", "_y", "_x", "_area", "_price")
    own = geo.in_cells(rows.withColumns({"_area": area, "_price": price, "_any": F.col("price_rub").isNull()}), reach).withColumn("_own", key).drop("_y", "_x")
    looks = own.where("_any or price_rub > 0").withColumn("_area", F.explode(areas)).withColumn("_price", F.explode(F.when(F.col("_any"), F.array(any_)).otherwise(prices)))
    looks = geo.in_cells(looks, reach, near=True).withColumn("_key", key).where("_any or _key >= _own")
    stands = geo.in_cells(rows.withColumn("_area", area).withColumn("_price", F.explode(F.when(F.col("price_rub") > 0, F.array(price, any_)).otherwise(F.array(any_)))), reach)
    left = geo.prefixed(looks.withColumn("_same", F.col("_key") == F.col("_own")).select(*cols, "_key", "_same", "_any"), "l")
    right = geo.prefixed(stands.withColumns({"_key": key, "_any": F.col("_price") == any_}).select(*cols, "_key", "_any"), "r")
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    close = l("price_rub").isNull() | r("price_rub").isNull() | ((l("price_rub") > 0) & (r("price_rub") > 0) & (F.abs(l("price_rub") - r("price_rub")) / F.greatest(l("price_rub"), r("price_rub")) <= max_price))
    once = (l("id") != r("id")) & (l("_any") == r("_any")) & (F.when(l("_any"), r("price_rub").isNotNull()).otherwise(~l("_same")) | (l("id") < r("id")))
    alike = l("rooms").eqNullSafe(r("rooms")) & (F.abs(l("area_total") - r("area_total")) <= max_area) & close
    # one key in the join; the rest is a condition that a hash of equal value can't pass
    held = F.coalesce(once & alike & (l("city") == r("city")) & (l("deal_type") == r("deal_type")), F.lit(False)) & geo.within_m((l("lat"), l("lon")), (r("lat"), r("lon")), radius_m, metres)
    met = left.join(right, (l("_key") == r("_key")) & held)
    first = l("id") < r("id")
    ends = [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("lr", "rl") for c in cols]
    met = met.select(*ends).withColumn("dist_m", metres((l("lat"), l("lon")), (r("lat"), r("lon"))))
    return met.orderBy("l_id", "r_id").limit(max_pairs) if max_pairs else met


def scored_pairs(pairs: DataFrame, least: float = 0.70) -> DataFrame:
    """(a, b, score) of the pairs that score `least` or more."""
    of = lambda tag: {c: F.col(f"{tag}_{c}") for c in _SCORED}
    return pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), tx.pair_score(of("l"), of("r")).alias("score")).where(F.col("score") >= least)


def pair_ids(pairs: DataFrame) -> DataFrame:
    """T4: the distinct ids of both ends."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def rows_of(listing: DataFrame, ids: DataFrame) -> DataFrame:
    """J9"""
    return listing.join(ids, "id", "left_semi")


def quality(as_of: Column) -> Column:
    """How complete and recent a listing is."""
    some = lambda c: F.col(c).isNotNull().cast("int")
    age = F.coalesce(F.greatest((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))) / 86400.0, F.lit(0.0)), F.lit(365.0))
    return some("area_total") + some("price_rub") + some("floor") + some("year_built") + some("house_material") + 2 * geo.has_point("lat", "lon").cast("int") + 3.0 / (1.0 + age)


def clusters(listing: DataFrame, as_of: Column, method: str = "geo+attrs") -> DataFrame:
    """(master_id, member_id, score, pair_score, method): every listing that isn't its
    cluster's survivor. score is 0.90 for all; pair_score is the member's best pair's."""
    pairs = stored(scored_pairs(candidate_pairs(listing)), "pairs")  # read twice below
    roots = connected_components(pairs)
    known = rows_of(listing, roots.select(F.col("node").alias("id"))).join(roots.withColumnRenamed("node", "id"), "id")
    ranked = known.withColumn("_q", quality(as_of))
    best = ranked.groupBy("root").agg(F.max(F.struct(F.col("_q"), (-F.col("id")).alias("_i"))).alias("_b")).select("root", (-F.col("_b._i")).alias("master_id"))
    edge = pairs.select(F.explode(F.array("a", "b")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("pair_score"))
    out = ranked.select("id", "root").join(best, "root").where("id <> master_id").join(edge, "id")
    out = stored(out.select("master_id", F.col("id").alias("member_id"), F.lit(0.90).alias("score"), "pair_score", F.lit(method).alias("method")), "clusters")
    dropped(pairs, roots)
    return out


def cluster_sizes(roots: DataFrame) -> DataFrame:
    """A10: clusters of two or more."""
    return roots.groupBy("root").agg(F.count("*").alias("members")).where("members >= 2")


def survivors(listing: DataFrame, groups: DataFrame, as_of: Column) -> DataFrame:
    """The best row of each group (root, id); ties by id."""
    w = Window.partitionBy("root").orderBy(F.desc("_q"), "id")
    return listing.join(groups, "id").withColumn("_q", quality(as_of)).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("root", "id")
