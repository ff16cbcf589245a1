"""Exact top-k search by distributed histogram selection.

Scores are inner products of integer vectors. A block of queries is broadcast, vectors are
scored where they lie, and each task reports, for each query, how many scores fall in each bin
of the query's present range; the sums tell which bin holds the kth score, and the range
narrows to it, some bits of the score a round. When each range is one score wide, one more pass
keeps what is above it, and of those equal to it the smallest ids.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored, tidy

_EXACT, _LONG = 2.0**53, 2.0**62  # sums below are exact as double, and fit a 64-bit integer
_CELLS = 1 << 20  # scores, or pairs kept of them, that are held at once
_FOUND = "q int, vec_id long, score long"


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, and without null or non-finite components."""
    fine = F.forall(embedding.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    return np.array([[math.floor(y) if math.isfinite(y := f * scale) else math.floor(f) * math.floor(scale) for f in row] for row in x.tolist()], object).reshape(x.shape)


class Block:
    """Queries of one length: their places in the broadcast block, rows and components."""

    def __init__(self, at: np.ndarray, row: np.ndarray, x: np.ndarray, scale: float) -> None:
        self.at, self.row, self.x, self.scale = at, row, x, scale
        with np.errstate(over="ignore"):
            self.v = np.floor(x * scale)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Integer inner products with the rows of `x`: by floating matrix product where that is
        exact, else by 64-bit integers, else by Python's. Those that leave 64 bits count as the
        nearest that doesn't, and the second result marks them."""
        with np.errstate(over="ignore", invalid="ignore"):
            c = np.floor(x * self.scale)
            most = np.abs(self.v).max(initial=0) * np.abs(c).sum(axis=1)
            most = np.where(np.isnan(most), np.inf, most)
        if (most < _EXACT).all():
            return (self.v @ c.T).astype(np.int64), None
        out, beyond = np.empty((len(self.v), len(c)), np.int64), None
        small, long = most < _EXACT, (most >= _EXACT) & (most < _LONG) & (np.abs(c).max(axis=1, initial=0) < _LONG)
        out[:, small] = (self.v @ c[small].T).astype(np.int64)
        if long.any() and np.abs(self.v).max(initial=0) >= _LONG:
            long = np.zeros(len(c), bool)
        if long.any():
            out[:, long] = self.v.astype(np.int64) @ c[long].astype(np.int64).T
        rest = ~(small | long)
        if rest.any():
            s = _whole(self.x, self.scale).dot(_whole(x[rest], self.scale).T) if x.shape[1] else np.zeros((len(self.v), rest.sum()), object)
            beyond = np.zeros(out.shape, bool)
            beyond[:, rest] = ((s > 2**63 - 1) | (s < -(2**63))).astype(bool)
            out[:, rest] = np.minimum(np.maximum(s, -(2**63)), 2**63 - 1).astype(np.int64)
        return out, beyond


def _met(batch: pa.RecordBatch, blocks: dict[int, list[Block]]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """Scores of a batch (row, vec_id, v): (block, ids, scores, which left 64 bits, which of them
    are pairs)."""
    col, row, ids = batch.column("v"), batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
    flat, starts = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    sizes = np.diff(starts)
    for n in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == n)
        for b in blocks.get(n, ()):
            step = max(1, _CELLS // len(b.at))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                x = flat[starts[part][:, None] + np.arange(n)]
                yield b, ids[part], *b.scores(x), b.row[:, None] != row[part][None, :]


def top_k(vectors: DataFrame, queries: Column | DataFrame, k: int = 10, scale: float = 1.0, query_block: int = 16384) -> DataFrame:
    """The `k` highest inner products of each query: query_id, rank (from 1), vec_id, score.

    `vectors` (vec_id, v: an array of numbers); `queries`: a condition that names rows of it,
    which are no candidates of their own, or a table of other vectors (vec_id, v). Components
    count as floor(scale * x), x as double, however large; a score among the highest that leaves
    64 bits is an error. Rows that aren't `usable` and rows with a null id take no part; pairs
    of unlike length have no score. Ties go to the smaller id; fewer than k candidates give all.
    Rows with repeated ids are candidates, and queries, each. No queries or vectors: no rows.
    Columns other than vec_id and v are ignored.

    Vectors are never shuffled or copied: each pass reads them where they lie, against one
    broadcast block of at most `query_block` queries. A task reports only bins from the top down
    to where it alone has what a query needs: no lower bin can hold the kth score, so at most k
    rows for each query and task are shuffled. Equal scores are cut to the k smallest ids inside
    each task, about a million pairs at a time, so that copies of a vector are no hot spot."""
    spark = vectors.sparkSession
    cast = lambda df, *more: df.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), *more)
    own = isinstance(queries, Column)
    vecs = stored(cast(vectors, F.monotonically_increasing_id().alias("row"), (F.coalesce(queries, F.lit(False)) if own else F.lit(False)).alias("asks")), "vectors")
    asked = vecs.where("asks") if own else stored(cast(queries, (-1 - F.monotonically_increasing_id()).alias("row")), "queries")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    with tidy(spark):
        m, most, longest = asked.agg(F.count("*"), F.max(size), F.max(F.size("v"))).first()
        top = vecs.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if not m:
        dropped(vecs, asked)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = ((most or 0.0) * scale + longest + 1) * ((top or 0.0) * scale + 1) * 1.001 + 1
    offset = int(bound) if bound < _LONG else 2**63  # scores and `offset` make unsigned numbers of `width` bits
    width = min(64, (2 * offset).bit_length())
    blocks = -(-m // query_block)
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "vec_id", "v").toPandas()  # about `query_block`
        if len(rows):
            found = _search(vecs, rows, k, scale, offset, width)
            out = found if out is None else out.unionByName(found)
    dropped(vecs, asked)
    return out


def _search(vecs: DataFrame, rows, k: int, scale: float, offset: int, width: int) -> DataFrame:
    """The results of one block of queries."""
    spark, n = vecs.sparkSession, len(rows)
    lengths, row = rows["v"].map(len).to_numpy(), rows["row"].to_numpy()
    sizes = np.array([np.abs(v).max(initial=0) for v in rows["v"]])
    blocks: dict[int, list[tuple]] = {}  # plain arrays: unpickling a class would need this package
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        at = at[np.argsort(sizes[at], kind="stable")]  # large components don't slow the others down
        for i in range(0, len(at), 512):
            part = at[i : i + 512]
            blocks.setdefault(d, []).append((part, row[part], np.array([rows["v"][j] for j in part], float).reshape(len(part), d)))
    held = spark.sparkContext.broadcast(blocks)

    def asked() -> dict[int, list[Block]]:
        return {d: [Block(*b, scale) for b in some] for d, some in held.value.items()}

    most = max(4, min(12, 23 - max(0, n - 1).bit_length()))  # a task's histograms take 2^23 counters at most
    shift, prefix, need = np.uint64(offset % 2**64), np.zeros(n, np.uint64), np.full(n, k, np.int64)
    left, table = width, vecs.select("row", "vec_id", "v")
    while left:
        bits = min(most, left)
        left -= bits
        at_bit, above_bit, bins = np.uint64(left), np.uint64(left + bits), 1 << bits
        state = spark.sparkContext.broadcast((prefix, need))

        def report(batches: Iterator[pa.RecordBatch], bins=bins, at_bit=at_bit, above_bit=above_bit, state=state) -> Iterator[pa.RecordBatch]:
            (prefix, need), blocks = state.value, asked()
            total = np.zeros((n, bins), np.int32)
            for batch in batches:
                for b, _, s, _, fine in _met(batch, blocks):
                    u = s.astype(np.uint64) + shift
                    if above_bit < 64:
                        fine &= (u >> above_bit) == prefix[b.at][:, None]
                    at = (np.arange(len(b.at)) * bins)[:, None] + ((u >> at_bit) & np.uint64(bins - 1)).astype(np.int64)
                    total[b.at] += np.bincount(at[fine], minlength=len(b.at) * bins).reshape(-1, bins).astype(np.int32)
            for i in range(0, n, 1024):
                part = total[i : i + 1024].astype(np.int64)
                over = np.cumsum(part[:, ::-1], axis=1)[:, ::-1] - part
                q, at = np.nonzero((part > 0) & (over < need[i : i + 1024][:, None]))
                yield pa.RecordBatch.from_pydict({"q": pa.array((q + i).astype(np.int32)), "bin": pa.array(at.astype(np.int32)), "n": pa.array(part[q, at])})

        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        sums = table.mapInArrow(report, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        needed = spark.createDataFrame(list(enumerate(need.tolist())), "q int, need long")
        with tidy(spark):  # the bin where the sum from the top first reaches the need: a row for each query of the block
            at = sums.join(needed, "q").where("upto >= need and upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("above")).toPandas()
        state.destroy()
        prefix <<= np.uint64(bits)
        q = at["q"].to_numpy()
        prefix[q] |= at["bin"].to_numpy().astype(np.uint64)
        need[q] -= at["above"].to_numpy()
        few = np.setdiff1d(np.arange(n), q)  # fewer than k candidates in all
        prefix[few], need[few] = 0, k
    last = spark.sparkContext.broadcast(prefix)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, found, size = asked(), [[np.empty(0, np.int64)] * 3], 0

        def cut() -> list[np.ndarray]:
            """The k best pairs of each query so far."""
            q, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, ~score, q))
            q, ids, score = q[order], ids[order], score[order]
            fine = np.arange(len(q)) - np.searchsorted(q, q) < k
            return [q[fine], ids[fine], score[fine]]

        for batch in batches:
            for b, ids, s, beyond, fine in _met(batch, blocks):
                fine &= s.astype(np.uint64) + shift >= last.value[b.at][:, None]
                if beyond is not None and (beyond & fine).any():
                    raise ValueError("one of the highest scores leaves 64-bit integers")
                q, c = np.nonzero(fine)
                found.append([b.at[q], ids[c], s[q, c]])
                size += len(q)
                if size >= _CELLS:  # ties: any number of pairs may reach the kth score
                    found, size = [cut()], 0
        best = cut()
        yield pa.RecordBatch.from_pydict({"q": pa.array(best[0].astype(np.int32)), "vec_id": pa.array(best[1]), "score": pa.array(best[2])})

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    ids = spark.createDataFrame([(i, int(v)) for i, v in enumerate(rows["vec_id"])], "q int, query_id long")
    named = table.mapInArrow(keep, _FOUND).withColumn("rank", rank).where(F.col("rank") <= k).join(ids, "q")
    found = stored(named.select("query_id", "rank", "vec_id", "score"), "found")
    held.destroy()
    last.destroy()
    return found
