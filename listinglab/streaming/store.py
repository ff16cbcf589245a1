"""A store of raw listings that is written by batches: what a batch writes grows with the batch.

Batch n lands as a delta, `batch=n`, the last row of each of its keys; nothing is read for it.
Every few batches a compaction folds the deltas into the base, `base=n`: only buckets that
deltas touch are read and rewritten, and a bucket that has grown too large is written as two,
four, ... of it. A bucket is named by the leading bits of its keys' hash. `manifest-n.json`, put
in place last and at once, names the buckets of a base and the last batch in it; without it a
compaction has not happened. Readers take the newest manifest and the deltas after it, newest
first. Batches and compactions that run again write the same again.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import upsert_raw
from ..sources.shared import dropped, stored

KEY = ["source", "deal_type", "external_id"]


@dataclass
class Manifest:
    """upto: the last batch in the base; buckets: their names ("depth-prefix") and where they
    lie below the folder (None: empty)."""

    upto: int
    buckets: dict[str, str | None]


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    return path, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str, start: str) -> dict[int, str]:
    """Numbers and names of what lies in the folder under `start`."""
    _, root, fs = _fs(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return {int(x[len(start) :].removesuffix(".json")): x for x in found if x.startswith(start)}


def manifest(spark: SparkSession, folder: str, upto: int, buckets: int = 1) -> Manifest:
    """The newest manifest of a base that ends by batch `upto`; of `buckets` empty buckets, a
    power of two, if there is none."""
    known = [n for n in _names(spark, folder, "manifest-") if n <= upto]
    if not known:
        depth = max(0, buckets - 1).bit_length()
        return Manifest(-1, {f"{depth}-{p}": None for p in range(1 << depth)})
    text = spark.read.text(f"{folder}/manifest-{max(known)}.json", wholetext=True).first()[0]
    return Manifest(max(known), json.loads(text))


def _named(rows: DataFrame, names: DataFrame, depths: list[int]) -> DataFrame:
    """`rows` with the bucket of `names` (bucket) that their key falls in."""
    h = F.xxhash64(*KEY)
    bucket = lambda d: F.concat(F.lit(f"{d}-"), (F.shiftrightunsigned(h, 64 - d) if d else F.lit(0)).cast("string"))
    return rows.withColumn("bucket", F.explode(F.array(*[bucket(d) for d in depths]))).join(names, "bucket", "left_semi")


def _depths(buckets) -> list[int]:
    return sorted({int(b.split("-")[0]) for b in buckets})


def upsert_batches(folder: str, arrived: Column | None = None, buckets: int = 1, every: int = 16, bucket_rows: int = 1_000_000) -> Callable[[DataFrame, int], None]:
    """ST1: a foreachBatch function that keeps raw listings in `folder`, as S6 would: the last
    row of a key wins. `arrived` is the time of arrival, by default the rows' own collected_at.
    `every`: batches between compactions; `bucket_rows`: a bucket with more is split."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = manifest(spark, folder, n - 1, buckets)
        none = spark.createDataFrame([], batch.schema)
        fresh = upsert_raw(none, batch, arrived if arrived is not None else F.col("collected_at")).drop("action")
        names = spark.createDataFrame([(b,) for b in now.buckets], "bucket string")
        _named(fresh, names, _depths(now.buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={n}")
        if n - now.upto >= every:
            compact(spark, folder, n, buckets, bucket_rows)

    return run


def _deltas(spark: SparkSession, folder: str, after: int, upto: int) -> list[tuple[int, str]]:
    path, _, fs = _fs(spark, folder)
    known = sorted(_names(spark, folder, "batch=").items())
    return [(n, f"{folder}/{x}") for n, x in known if after < n <= upto and fs.exists(path(f"{folder}/{x}/_SUCCESS"))]


def _newest(rows: DataFrame, more: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*KEY, "_batch", *more)]
    keep = [F.max_by(F.struct(*rest), "_batch").alias("_r"), *[F.max_by(c, "_batch").alias(c) for c in more]]
    return rows.groupBy(*KEY).agg(*keep).select(*KEY, "_r.*", *more)


def _read(spark: SparkSession, now: Manifest, deltas: list[tuple[int, str]], folder: str, only: set[str] | None) -> DataFrame | None:
    """Base and deltas with `_batch` and `bucket`; of the base only some buckets, if wanted."""
    out, bases = None, {}
    for b, p in now.buckets.items():
        if p and (only is None or b in only):
            bases.setdefault(p.split("/")[0], []).append(f"{folder}/{p}")
    parts = [(-1, spark.read.option("basePath", f"{folder}/{base}").parquet(*paths)) for base, paths in bases.items()]
    parts += [(n, spark.read.parquet(p)) for n, p in deltas if _has_rows(spark, p)]
    for n, df in parts:
        df = df.withColumn("_batch", F.lit(n)).withColumn("bucket", F.col("bucket").cast("string"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _has_rows(spark: SparkSession, folder: str) -> bool:
    path, root, fs = _fs(spark, folder)
    return any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(root))


def compact(spark: SparkSession, folder: str, n: int, buckets: int = 1, bucket_rows: int = 1_000_000) -> None:
    """Folds the deltas up to batch `n` into a base. Names of buckets, and their sizes, reach the
    driver; there is one for each `bucket_rows` rows."""
    now = manifest(spark, folder, n - 1, buckets)
    deltas = _deltas(spark, folder, now.upto, n)
    some = _read(spark, Manifest(-1, {}), deltas, folder, None)
    kept = dict(now.buckets)
    if some is not None:
        touched = {r["bucket"] for r in some.select("bucket").distinct().collect()}
        rows = stored(_newest(_read(spark, now, deltas, folder, touched), ["bucket"]), "compacted")
        deeper = {}
        for r in rows.groupBy("bucket").count().collect():
            depth, prefix = map(int, r["bucket"].split("-"))
            more = max(0, -(-r["count"] // bucket_rows) - 1).bit_length()
            deeper |= {f"{depth + more}-{(prefix << more) + k}": r["bucket"] for k in range(1 << more)}
        names = spark.createDataFrame([(b,) for b in deeper], "bucket string")
        _named(rows.drop("bucket"), names, _depths(deeper)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/base={n}")
        dropped(rows)
        path, _, fs = _fs(spark, folder)
        written = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(path(f"{folder}/base={n}")) if s.getPath().getName().startswith("bucket=")}
        kept = {b: p for b, p in kept.items() if b not in touched} | {b: f"base={n}/bucket={b}" if b in written else None for b in deeper}
    _put(spark, folder, n, kept)
    _tidy(spark, folder)


def _put(spark: SparkSession, folder: str, n: int, kept: dict[str, str | None]) -> None:
    path, _, fs = _fs(spark, folder)
    new = path(f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(json.dumps(kept).encode())
    out.close()
    fs.delete(path(f"{folder}/manifest-{n}.json"), False)
    fs.rename(new, path(f"{folder}/manifest-{n}.json"))


def _tidy(spark: SparkSession, folder: str) -> None:
    """Removes what only manifests before the last two read: a replay may need the last but one."""
    path, _, fs = _fs(spark, folder)
    known = sorted(_names(spark, folder, "manifest-"))
    if len(known) < 3:
        return
    needed = {p for n in known[-2:] for p in manifest(spark, folder, n).buckets.values() if p}
    for n, x in _names(spark, folder, "base=").items():
        if n <= known[-2]:
            for s in fs.listStatus(path(f"{folder}/{x}")):
                if s.getPath().getName().startswith("bucket=") and f"{x}/{s.getPath().getName()}" not in needed:
                    fs.delete(s.getPath(), True)
    for n, x in _names(spark, folder, "batch=").items():
        if n <= known[-2]:
            fs.delete(path(f"{folder}/{x}"), True)
    for n in known[:-2]:
        fs.delete(path(f"{folder}/manifest-{n}.json"), False)


def snapshot(spark: SparkSession, folder: str, upto: int) -> DataFrame | None:
    """The rows after batch `upto`; None without any."""
    now = manifest(spark, folder, upto)
    rows = _read(spark, now, _deltas(spark, folder, now.upto, upto), folder, None)
    return None if rows is None else _newest(rows.drop("bucket"), [])
