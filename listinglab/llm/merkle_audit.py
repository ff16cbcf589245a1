"""WARC fixity audit with Merkle trees.

A replica's records are hashed, ordered ranges of offsets become leaves, and each level above
hashes up to `fanout` nodes in order, up to one root for each file. Two replicas are compared
from the roots down, and only below nodes that differ.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def warc_records(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """Response records of `pages` (page_id, url, html) for WARC files of `per_file` page ids
    each: file, page_id, record. Null urls and pages are empty; null ids lie in file -1."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long")
    return pages.select(file.alias("file"), "page_id", F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def digest(record: Column | str) -> Column:
    """sha256 of a record; null as empty."""
    c = F.col(record) if isinstance(record, str) else record
    return F.sha2(F.coalesce(c.cast("binary"), F.lit("").cast("binary")), 256)


def indexed(records: DataFrame, others: dict[str, Column] | None = None) -> DataFrame:
    """The index of WARC files (file, page_id, record): file, offset (the lengths before a
    record in its file, by page_id), page_id, digest, and the digest of each of `others`, other
    states of the record. Records are hashed where they are read: only digests travel."""
    named = {k: digest(v) for k, v in (others or {}).items()}
    rows = records.select("file", "page_id", F.octet_length("record").alias("_n"), digest("record").alias("digest"), *[v.alias(k) for k, v in named.items()])
    w = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("offset"), "page_id", "digest", *named)


def digests(records: DataFrame, hashed: bool = False) -> DataFrame:
    """file, offset, digest (of `record`, or with `hashed` the column itself), n: repeated rows
    are one with their number. Other columns are left out."""
    d = F.col("digest") if hashed else digest("record")
    return records.groupBy("file", "offset", d.alias("digest")).agg(F.count("*").alias("n"))


def _hashed(entries: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(entries), ","), 256)


def leaves(hashed: DataFrame, span: int) -> DataFrame:
    """Level 0: file, node (number of the range of `span` offsets), hash."""
    entry = F.concat(F.lpad(F.col("offset").cast("string"), 20, "0"), F.lit(":"), "digest", F.lit(":"), F.col("n").cast("string"))
    return hashed.groupBy("file", F.floor(F.col("offset") / span).alias("node")).agg(_hashed(F.collect_list(entry)).alias("hash"))


def tree(hashed: DataFrame, span: int, fanout: int, levels: int) -> list[DataFrame]:
    """The levels of each file's tree from the leaves to the root, stored as they are made."""
    out = [stored(leaves(hashed, span), "level")]
    for _ in range(levels):
        entry = F.concat(F.lpad(F.col("node").cast("string"), 20, "0"), F.lit(":"), "hash")
        out.append(stored(out[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(_hashed(F.collect_list(entry)).alias("hash")), "level"))
    return out


def audit(left: DataFrame, right: DataFrame, span: int = 1 << 16, fanout: int = 16, hashed: bool = False) -> DataFrame:
    """Where two replicas (file, offset, record; with `hashed` digest instead of record) differ:
    file, offset, kind (changed, missing or extra on the right), left_digest, right_digest.

    A leaf holds the records of one range of offsets, a node `fanout` nodes, so no task
    gathers a file, however large. The descent joins only children of differing nodes, then
    only records of differing ranges. Null files or offsets are left out of trees and reported
    by a direct comparison; repeated rows count. Empty replicas have no nodes: all rows of the
    other are missing or extra."""
    a, b = stored(digests(left, hashed), "digests"), stored(digests(right, hashed), "digests")
    top = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels, reach = 0, span
    while reach <= top:
        levels, reach = levels + 1, reach * fanout
    placed = "file is not null and offset is not null"
    ta, tb = tree(a.where(placed), span, fanout, levels), tree(b.where(placed), span, fanout, levels)
    differ = None
    for x, y in zip(reversed(ta), reversed(tb), strict=True):
        if differ is not None:  # children of differing nodes only
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout)).join(differ.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y.withColumnRenamed("hash", "other"), ["file", "node"], "full")
        differ = stored(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"), "differ")
    bad = differ.select("file", F.col("node").alias("_leaf"))
    inside = lambda t: t.where(placed).withColumn("_leaf", F.floor(F.col("offset") / span)).join(bad, ["file", "_leaf"], "left_semi").drop("_leaf").unionByName(t.where(f"not ({placed})"))
    named = lambda t, tag: inside(t).groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_list(F.concat("digest", F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise("")))), ",").alias(tag))
    x, y = named(a, "left_digest").alias("x"), named(b, "right_digest").alias("y")
    met = x.join(y, F.col("x.file").eqNullSafe(F.col("y.file")) & F.col("x.offset").eqNullSafe(F.col("y.offset")), "full")
    kind = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return met.where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select(F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.offset", "y.offset").alias("offset"), kind.alias("kind"), "left_digest", "right_digest")
