"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of SparkContext.setCheckpointDir. A local master,
    as in tests, gets a new temporary one if both are unset; a cluster must name its own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="listinglab-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the shuffle files of an action are removed when the action ends. For
    actions whose result no longer needs them: a written table, or a few numbers. The frame
    that acts must be made inside."""
    old = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if old is None else spark.conf.set(_TIDY, old)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written as Parquet in the shared folder and read again, so that its lineage ends
    and no lost executor takes it along. `dropped` removes it; else the folder's owner does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/listinglab/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("parquet.block.size", 32 << 20).parquet(path)  # small row groups: less memory in each writer
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `stored` wrote. Only for tables that no later plan reads."""
    for df in tables:
        if path := _FOLDERS.pop(df, None):
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
