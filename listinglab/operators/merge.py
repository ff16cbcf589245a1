"""Keyed upserts of one table into another, as snapshots."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def differs(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two rows of columns are distinct, nulls being equal."""
    return ~F.struct(*a).eqNullSafe(F.struct(*b))


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order` (ties: the greatest row)."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


KEY_HASH = "key_hash"  # the column that tables of `save_bucketed` are bucketed by


def _same_value(a: Column, b: Column) -> Column:
    """Equal, or both null, in a form that Spark takes for a condition and not for a join key:
    the buckets must hold all join keys, and they know the hash only."""
    return ((a <= b) & (a >= b)) | (a.isNull() & b.isNull())


def save_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int, dealt: bool = False) -> DataFrame:
    """`rows` as the table `table` of that many buckets, by a hash of the keys in which nulls
    count too; the table. `dealt`: the rows are what merge_upsert made of a table of as many
    buckets, so that each task holds one bucket already and nothing moves. A table can't be
    written from itself: a new snapshot takes a new name."""
    hashed = rows.withColumn(KEY_HASH, F.xxhash64(*keys))
    if not dealt:
        hashed = hashed.repartition(buckets, KEY_HASH)
    hashed.write.format("parquet").bucketBy(buckets, KEY_HASH).sortBy(KEY_HASH).saveAsTable(table)
    return rows.sparkSession.table(table)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], insert_only: list[str] = (), touch: list[str] = (), touch_unchanged: bool = False) -> DataFrame:
    """The snapshot of `target` after `source` (one row a key), with `action`: inserted,
    updated, unchanged or kept (not in the source).

    A known key changes only if one of the `update` columns does; then these and the `touch`
    columns are taken. `insert_only` columns keep what was first inserted. Rows seen again
    without a change keep their `touch` columns too, unless `touch_unchanged`. Keys compare
    with nulls equal. One join on the keys; the target isn't changed in place. A target that
    `save_bucketed` wrote by these keys is met where it lies: only the source is shuffled."""
    by_hash = KEY_HASH in target.columns
    if by_hash:
        source = source.withColumn(KEY_HASH, F.xxhash64(*keys))
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    same = _same_value if by_hash else Column.eqNullSafe
    on = reduce(lambda a, b: a & b, [same(F.col(f"t.{k}"), F.col(f"s.{k}")) for k in keys])
    if by_hash:
        on = (F.col(f"t.{KEY_HASH}") == F.col(f"s.{KEY_HASH}")) & on
    new, seen = F.col("_t").isNull(), F.col("_s").isNotNull()
    changed = differs([F.col(f"t.{c}") for c in update], [F.col(f"s.{c}") for c in update])
    action = F.when(new, "inserted").when(~seen, "kept").when(changed, "updated").otherwise("unchanged")
    take = F.col("action").isin("inserted", "updated")
    touched = take | (F.col("action") == "unchanged") if touch_unchanged else take
    pick = lambda when, c: F.when(when, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    both = t.join(s, on, "full").withColumn("action", action)
    cols = [F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys]
    cols += [pick(take, c) for c in update] + [pick(new, c) for c in insert_only] + [pick(touched, c) for c in touch]
    return both.select(*cols, "action")


def upsert_counts(merged: DataFrame) -> DataFrame:
    """Rows by action."""
    return merged.groupBy("action").agg(F.count("*").alias("n"))


def continued_ids(known: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`new` with ids that go on behind the greatest known one, in `order`. Ranks are
    summed up from ranges of the order, so no single task numbers all rows; the ranges are
    stored, as they are read twice and must be the same."""
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    ranged = stored(new.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_before")).crossJoin(top))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(starts, "_p").withColumn(key, (F.col("_top") + F.col("_before") + place).cast("long")).drop("_p", "_before", "_top")
