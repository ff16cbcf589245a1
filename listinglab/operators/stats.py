"""Counts, errors and intervals."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored, tidy


def data_stats(listing: DataFrame, raw: DataFrame) -> DataFrame:
    """A4: one row of six counts: active long rents, active sales and all active listings; long
    rents, sales and all rows of the raw table. One pass over each."""
    of = lambda deal: F.col("deal_type") == deal
    a = listing.where("is_active").agg(F.count_if(of("rent_long")).alias("rent_count"), F.count_if(of("sale")).alias("sale_count"), F.count("*").alias("total"))
    b = raw.agg(F.count_if(of("rent_long")).alias("rent_raw_count"), F.count_if(of("sale")).alias("sale_raw_count"), F.count("*").alias("total_raw"))
    return a.crossJoin(b)  # one row each


def errors(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """Mae, rmse and mape (percent; zero truths are left out), one row."""
    e = F.col(truth) - F.col(estimate)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(F.col(truth) != 0, F.abs(e / F.col(truth)))) * 100).alias("mape"))


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of numeric columns, without nulls: for each
    name a value for each of `shares`, null where there are no values.

    Equal values are counted first; the distinct ones are dealt out by ranges, and only the
    range that holds a rank is looked into. So no task holds all values, and a few numbers for
    each column reach the driver."""
    spark = df.sparkSession
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])).alias("p")
    counts = df.select(pairs).select("p.*").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()), "values")
    sums = ranged.groupBy("name", "part").agg(F.sum("n").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    with tidy(spark):
        starts = sums.select("name", "part", before.alias("start"), "n").collect()
    total: dict[str, int] = {}
    for r in starts:
        total[r["name"]] = max(total.get(r["name"], 0), r["start"] + r["n"])
    ranks = {(n, k) for n, m in total.items() for q in shares for k in (math.floor(q * (m - 1)), math.ceil(q * (m - 1)))}
    wanted = [(r["name"], r["part"], k - r["start"], k) for r in starts for n, k in ranks if n == r["name"] and r["start"] <= k < r["start"] + r["n"]]
    found = {}
    if wanted:
        seek = F.broadcast(spark.createDataFrame(wanted, "name string, part int, place long, rank long"))  # two rows for each quantile
        upto = F.sum("n").over(Window.partitionBy("name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        inside = ranged.join(seek.select("name", "part").distinct(), ["name", "part"], "left_semi").withColumn("upto", upto)
        with tidy(spark):
            hits = inside.join(seek, ["name", "part"]).where("place < upto and place >= upto - n").select("name", "rank", "value").collect()
        found = {(r["name"], r["rank"]): r["value"] for r in hits}
    dropped(ranged)
    out: dict[str, list[float | None]] = {}
    for name in columns:
        m = total.get(name, 0)
        at = [q * (m - 1) for q in shares]
        out[name] = [found[name, math.floor(p)] * (1 - (p - math.floor(p))) + found[name, math.ceil(p)] * (p - math.floor(p)) if m else None for p in at]
    return out


def _one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{c}` double" for c in values))


def conformal_radius(df: DataFrame, truth: str, estimate: str, q: float = 0.9) -> DataFrame:
    """The `q` quantile of absolute errors, with linear interpolation, one row."""
    found = quantiles(df, {"eps": F.abs(F.col(truth) - F.col(estimate))}, [q])
    return _one_row(df, {"eps": found["eps"][0]})


def residual_quantiles(df: DataFrame, truth: str, estimate: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Quantiles of signed errors, one row."""
    found = quantiles(df, {"e": F.col(truth) - F.col(estimate)}, [low, high])["e"]
    return _one_row(df, {"low": found[0], "high": found[1]})


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5: one row; exact medians without nulls."""
    return _one_row(df, {c: v[0] for c, v in quantiles(df, {c: F.col(c) for c in columns}, [0.5]).items()})
