"""Helpers shared by the operators: texts as bytes, hashes of words, components of links."""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, texts go to Python workers in batches of at most `rows`."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def utf8(text: Column | str) -> Column:
    """The bytes of a text, null as empty: Python workers then need not decode it."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def components(links: DataFrame, hops: int = 2) -> DataFrame:
    """Connected components of `links` (a, b): (node, component), component being the
    smallest node reachable. No links: no rows. In a round every node takes, `hops` times, the
    least root among its own and its neighbours', then that root's own root; the loop ends when
    none has changed. (Components by contraction stand in `operators`; op6 has been measured
    with these.) Only the flag of a change reaches the driver."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    table = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    while True:
        roots = table.select("node", "root")
        step = roots.withColumn("now", F.col("root"))
        for _ in range(hops):
            near = edges.join(step.select(F.col("node").alias("b"), F.col("now").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r")).toDF("node", "r")
            step = step.join(near, "node").select("node", "root", F.least("now", "r").alias("now"))
            step = step.join(roots.toDF("now", "top"), "now").select("node", "root", F.least("now", "top").alias("now"))
        new = stored(step.selectExpr("node", "now as root", "now <> root as moved"), "roots")
        dropped(table)
        table = new
        if not new.where("moved").take(1):
            dropped(edges)
            return new.select("node", F.col("root").alias("component"))


_K = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_PIECE = 1 << 16  # bytes of a text that are hashed at a time
_LONG = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """64-bit hashes of a text's words in order: A-Z lower-cased, parted by space and U+0009 to
    U+000D. A word's hash is a polynomial of its bytes; running sums over a piece of text give
    those of all its words at once. Words of more than `_LONG` bytes, on which polynomials
    modulo 2^64 may agree by construction, are hashed by xxh3."""

    def __init__(self) -> None:
        self.space = np.isin(np.arange(256), [32, *range(9, 14)])
        self.value = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _K)
        self.value[65:91] = self.value[97:123]
        self._reach(_PIECE)

    def _reach(self, n: int) -> None:
        of = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
        self.power, self.inverse = of(_BASE), of(pow(_BASE, -1, 2**64))

    def __call__(self, text: bytes) -> np.ndarray:
        if len(text) <= _PIECE:
            return self._hashed(text)[0]
        out, at = [], 0
        while at < len(text):
            cut = text.find(b" ", at + _PIECE)
            cut = len(text) if cut < 0 else cut
            out.append(self._hashed(text[at:cut])[0])
            at = cut
        return np.concatenate(out)

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of several texts, and how many each has."""
        if len(texts) == 1:
            h = self(texts[0])
            return h, np.array([len(h)])
        h, starts = self._hashed(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return h, np.diff(np.searchsorted(starts, ends), prepend=0)

    def _hashed(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and where they start."""
        b = np.frombuffer(text, np.uint8)
        n = len(b)
        if n >= len(self.power):
            self._reach(n)
        solid = np.zeros(n + 2, bool)
        np.logical_not(self.space[b], out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[b] * self.power[:n], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * self.inverse[starts])
        for k in np.flatnonzero(ends - starts > _LONG):
            h[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]].translate(_LOWER))
        return h, starts


def gathered(texts: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, list[bytes]]]:
    """A column of texts in runs of about `most` bytes, each with the place of its first."""
    held, first, size = [], 0, 0
    for k, b in enumerate(texts):
        held.append(b.as_py())
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, first, size = [], k + 1, 0
    if held:
        yield first, held
