"""Price history."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def price_changes(observed: DataFrame) -> DataFrame:
    """Of (listing_id, ts, seq, price_rub), the rows that log a new price: the first
    if not null, and any that differs from the one before. A change to null is not logged."""
    before = F.lag("price_rub").over(Window.partitionBy("listing_id").orderBy("ts", "seq"))
    return observed.withColumn("_p", before).where("price_rub is not null and not (price_rub <=> _p)").select("listing_id", "ts", "seq", "price_rub")
