"""Mixing sources to target weights by capped water-filling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_HEX = 3  # hex digits of the seeded key that name a bucket: 4096 buckets for each source


def words_in(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_table(sized: DataFrame, weights: list[float]) -> DataFrame:
    """Sources with their size and weight: in code point order, null last, weights repeat in
    turn. Ranks come from ranges of the sorted sources, so no task sorts them all."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stored(sums.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("pid", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("pid").agg(F.count("*").alias("n")).select("pid", before.alias("start"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return ranged.join(starts, "pid").select("source", "source_size", weight.alias("weight"))


def water_level(sources: DataFrame, total: float, epochs: float) -> float:
    """The share of one unit of weight once no source is above `epochs` times its size: those
    above it are clamped, what they leave goes to the others by weight, until none is above.
    Each round is one sum over the sources; only the sums come to the driver."""
    cap, level = F.col("source_size") * F.lit(float(epochs)), 0.0
    while True:
        over = F.col("weight") * F.lit(level) > cap
        free, clamped, n = sources.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap)), F.count_if(over)).first()
        new = (total - (clamped or 0.0)) / free if free else level
        if new <= level or not free:
            return level
        level = new


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """What a mix takes of each row: the rows of `docs` with size, source_size, target and
    taken (existing columns of these names are replaced).

    Sources share `share` times the sum of all sizes by `weights`, none above `epochs` times
    its own size. A source's rows are taken floor(target / size) times whole; the rest goes to
    rows in the order of md5(seed, doc_id), each once more, the last of them in part. So a
    source's words equal its target, rounded, and no row exceeds ceil(epochs) times its size.

    A source of any size is dealt over 4096 buckets of that order: bucket sums tell how much
    is left before each bucket, and rows are summed inside a bucket only. Null source: a
    source like others, ranked last. Null or empty text: size 0, taken 0. Rows with the same
    id stay apart (ties by size, then text hash). No rows give no rows."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "__key", "__bucket", "__text")]
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(*own, words_in(F.col("text")).alias("size"), key.alias("__key"), F.xxhash64("text").alias("__text")).withColumn("__bucket", F.substring("__key", 1, _HEX))
    sums = stored(docs.select("source", words_in(F.col("text")).alias("size"), F.substring(key, 1, _HEX).alias("__bucket")).groupBy("source", "__bucket").agg(F.sum("size").alias("size")), "buckets")
    sources = stored(source_table(sums, weights), "weighted")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total, epochs)
    targets = sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(epochs))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.select("source", "source_size", "target", whole.alias("__whole")).withColumn("__rest", F.round(F.col("target") - F.col("__whole") * F.col("source_size")).cast("long"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = sums.select("source", "__bucket", before.alias("__before"))
    plan = dealt.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(F.col("d.source").alias("__source"), F.col("__bucket").alias("__b"), "__before", "source_size", "target", "__whole", "__rest")
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "size", "__text").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    left = F.col("__rest") - F.col("__before") - (F.sum("size").over(inside) - F.col("size"))
    extra = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return joined.withColumn("taken", (F.col("__whole") * F.col("size") + extra).cast("long")).select(*own, "size", "source_size", "target", "taken")
