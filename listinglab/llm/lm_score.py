"""Language-model scores by stupid backoff, computed relationally.

A word after others scores count(run) / count(the run's other words as context) if the run was
counted at least `least` times, else `alpha` times its score after one word less; without
context it scores count(word) / words. Runs (n-grams) have at most `order` words, fewer at a
text's beginning. A text's score is the sum of the logarithms.

There is a table of counts for each order, parted by the n-gram's hash. A run counted `least`
times has shorter runs counted as often, so its logarithm is found by joining its order's table
to that of the order below. A text's score is then the sum, over its words, of the logarithm of
the longest counted run that ends there, and of what backing off to it costs: texts' exploded
n-grams, the longest for each word, are joined to the tables and summed for each text. What of a
score needs no table travels beside them, in a row of the text's own.

Two tables of bounded size, broadcast, spare the shuffle rows: bits that are set for all n-grams
counted `least` times, and the logarithms of n-grams with a fixed share of all words, of which
there can be few. The few rarer n-grams whose bits are set as well stand in the tables with what
backing off gives them, so that every n-gram that the bits let through is found. The hashes'
range is worked through in slices, and each slice's shuffle is gone before the next begins.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored, tidy
from .common import Words, gathered, small_batches, utf8

_CHUNK = 1 << 20  # words that a task gathers before it sends their n-grams
_SHARE = 1 << 19  # an n-gram with one in so many words is common
_OFTEN = 1000  # and is so only if it stands so often: the table is for hot keys
_ROWS = 1 << 16  # rows of a batch to Spark
_PART = 22  # log2 of the bytes of text for each part of the counts, of which there are 256 at least
_SHIFT = 10  # log2 of the n-grams for each bit of the table from which its parts are split
_RUN = 18  # log2 of the bits of a part of the table


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for two longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h: np.ndarray | np.uint64 = np.uint64(42)
        for x in (a, b):
            h = (h + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
            h = turn(h, 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return h


class Grams:
    """The n-grams of several texts at once. All texts' words stand in one row: `all[k - 1]` has
    the hash of the k words from each place on, made of those of the first and of the last k - 1;
    `at[k - 1]` the places from which k words are of one text; `text` and `last` tell for each
    word which text it is of, and whether it is its last; `n` how many words each text has."""

    def __init__(self, order: int) -> None:
        self.words, self.order = Words(), order

    def of(self, texts: list[bytes]) -> None:
        h, self.n = self.words.of_texts(texts)
        text = np.repeat(np.arange(len(texts)), self.n)
        last = np.concatenate([text[1:] != text[:-1], [True]])[: len(text)]
        self.all, self.at = [h], [np.arange(len(h))]
        for k in range(1, min(self.order, len(h))):
            g = self.all[-1]
            self.all.append(pair_hash(g[:-1], g[1:]))
            self.at.append(np.flatnonzero(text[:-k] == text[k:]))
        self.text, self.last = text, last

    def hashes(self, k: int) -> np.ndarray:
        """Those of all n-grams of k words."""
        return self.all[k - 1][self.at[k - 1]] if k <= len(self.all) else self.all[0][:0]


def _size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    with tidy(docs.sparkSession):
        return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated(docs: DataFrame, order: int, bits: int, size: int | None = None) -> np.ndarray:
    """2^bits bits, set for every n-gram of 2 to `order` words that stands twice or more (and
    for some others)."""
    run_bits = min(_RUN, bits)
    chunks, of, mask = 1 << (bits - run_bits), 1 << (run_bits - 16), np.uint64((1 << bits) - 1)
    size = _size(docs) if size is None else size
    turns = max(1, int(size * order / 2.0 ** (bits + _SHIFT)))  # groups of one chunk: what they gather is bounded

    def packed(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
        """Ordered numbers, some twice: how many have each of the highest bits, and the lower and the
        upper byte of the steps of their lowest 16 bits."""
        return n.tobytes() + pa.compress(low.tobytes() + high.tobytes(), codec="zstd", asbytes=True)

    def unpacked(b: bytes) -> np.ndarray:
        n = np.frombuffer(b, np.uint32, of)
        m = int(n.sum())
        steps = np.frombuffer(pa.decompress(b[4 * of :], 2 * m, codec="zstd", asbytes=True), np.uint8)
        low = np.cumsum(steps[:m] | steps[m:].astype(np.uint16) << np.uint16(8), dtype=np.uint16)
        return low | np.repeat(np.arange(of, dtype=np.uint32) << np.uint32(16), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, size, turn = Grams(order), [], 0, 0

        def sent() -> pa.RecordBatch:
            at = np.concatenate(held)
            held.clear()
            at &= mask
            at = at.astype(np.uint32)
            at.sort()
            new = np.concatenate([[True], at[1:] != at[:-1]])
            second = np.concatenate([[False], ~new[1:] & new[:-1]])  # the first repetition: two of each are enough
            at = at[new | second]
            n = np.bincount(at >> np.uint32(16), minlength=chunks * of).astype(np.uint32).reshape(chunks, of)
            some = np.flatnonzero(n.any(axis=1))
            cuts = np.concatenate([[0], np.cumsum(n.sum(axis=1, dtype=np.int64)[some])])
            low = at.astype(np.uint16)
            steps = np.diff(low, prepend=np.uint16(0))  # modulo 2^16
            steps[cuts[:-1]] = low[cuts[:-1]]
            low, high = steps.astype(np.uint8), (steps >> np.uint16(8)).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"part": pa.array(some * turns + turn % turns), "b": pa.array([packed(n[k], low[i:j], high[i:j]) for k, i, j in zip(some, cuts, cuts[1:])], pa.binary())})  # noqa: B905

        for batch in batches:
            for _, texts in gathered(batch.column("b")):
                grams.of(texts)
                held += [grams.hashes(k) for k in range(2, order + 1)]
                size += sum(map(len, held[1 - order :]))
                if size > 2 * _CHUNK:
                    yield sent()
                    held, size, turn = [], 0, turn + 1
        if size:
            yield sent()

    def bitmaps(n: np.ndarray, part: int) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int64()), "one": pa.array([np.packbits(n > 0, bitorder="little").tobytes()], pa.binary()), "two": pa.array([np.packbits(n > 1, bitorder="little").tobytes()], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        n, held, size = np.zeros(1 << run_bits, np.int64), [], 0
        for b in table["b"]:
            held.append(unpacked(b.as_py()))
            size += len(held[-1])
            if size > _CHUNK:
                n += np.bincount(np.concatenate(held), minlength=len(n))
                held, size = [], 0
        if size:
            n += np.bincount(np.concatenate(held), minlength=len(n))
        return bitmaps(n, table["part"][0].as_py() // turns)

    def joined(table: pa.Table) -> pa.Table:
        n = np.zeros(1 << run_bits, np.int64)
        for one, two in zip(table["one"].to_pylist(), table["two"].to_pylist(), strict=True):
            for b in (one, two):
                n += np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")
        return bitmaps(n, table["part"][0].as_py())

    with tidy(docs.sparkSession):
        rows = docs.select(utf8("text").alias("b")).mapInArrow(run, "part long, b binary").groupBy("part").applyInArrow(merged, "part long, one binary, two binary")
        if turns > 1:
            rows = rows.groupBy("part").applyInArrow(joined, "part long, one binary, two binary")
        rows = rows.select("part", "two").collect()  # 2^bits bits in all
    out = np.zeros((chunks, 1 << (run_bits - 3)), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["two"], np.uint8)
    return out.reshape(-1)


def _twice(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the n-grams `g` may stand twice."""
    at = (g & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _worth(grams: Grams, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: its place, the hashes from each word on, and the places of those n-grams
    that may stand twice: of words all, of others those whose bit is set, and whose first and
    last n - 1 words may stand twice as well."""
    fine = None
    for k, (g, at) in enumerate(zip(grams.all, grams.at, strict=True)):
        if k and bits is not None:
            if fine is not None:
                at = at[fine[at] & fine[at + 1]]
            at = at[_twice(bits, g[at])]
            fine = np.zeros(len(g), bool)
            fine[at] = True
        yield k, g, at


def _batches(**cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(cols.values())))
    for i in range(0, n, _ROWS):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + _ROWS].view(np.int64) if v.dtype == np.uint64 else v[i : i + _ROWS]) for k, v in cols.items()})


def _ordered(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that put hashes in order, and these in order. Their highest bits are sorted with the
    place in the lowest ones, which is several times faster than argsort; where that isn't enough to
    tell two of them apart, argsort does it."""
    low = np.uint64(max(1, len(g) - 1).bit_length())
    key = (g >> low << low) | np.arange(len(g), dtype=np.uint64)
    key.sort()
    at = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    out = g[at]
    if (out[1:] < out[:-1]).any():
        at = np.argsort(g)
        out = g[at]
    return at, out


def _packed(first: np.ndarray, last: np.ndarray, n: np.ndarray, ends: np.ndarray) -> bytes:
    """Counts of some n-grams as bytes."""
    small = pa.compress(np.concatenate([n, ends]).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
    return len(n).to_bytes(4, "little") + first.tobytes() + last.tobytes() + small


def _unpacked(b: bytes) -> tuple[np.ndarray, ...]:
    m = int.from_bytes(b[:4], "little")
    small = np.frombuffer(pa.decompress(b[4 + 16 * m :], 8 * m, codec="zstd", asbytes=True), np.uint32).astype(np.int64)
    return np.frombuffer(b, np.uint64, m, 4), np.frombuffer(b, np.uint64, m, 4 + 8 * m), small[:m], small[m:]


def gram_counts(docs: DataFrame, order: int, least: int, marks, slices: int, size: int | None = None) -> list[DataFrame]:
    """The counts of n-grams, in one table for each slice of hashes: k (its words), first (hash
    of its first k - 1 words), last (of its last k - 1; of words: 0 and the word's own), n (times
    it stands), ctx (times another word follows). Of two and more words, only those that stand
    `least` times. With `marks` there are also those that stand less often but share their bit
    with one that does, and rows of k = 0: these bits, for the part `first` of the hashes."""
    width = (8 * len(marks.value)).bit_length() - 1 if marks else 28
    p = min(width - 3, max(8, ((_size(docs) if size is None else size) >> _PART).bit_length()))  # log2 of the parts
    low, shift = np.uint64((1 << width) - 1), np.uint64(width - p)
    turn = lambda g: (g << np.uint64(64 - width)) | (g >> np.uint64(width))  # noqa: E731  by parts

    def part(slice_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, bits, size = Grams(order), marks.value if marks else None, 0
            held: list[list] = [[] for _ in range(order)]

            def sent() -> Iterator[pa.RecordBatch]:
                for k, rows in enumerate(held, 1):
                    if not rows:
                        continue
                    g, first, last, end = (np.concatenate(x) for x in zip(*rows, strict=True))
                    rows.clear()
                    if not len(g):
                        continue
                    at, g = _ordered(turn(g))
                    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    n, ends = np.diff(np.append(new, len(g))), np.add.reduceat(end[at].astype(np.int64), new)
                    first, last, of = first[at[new]], last[at[new]], (g[new] >> np.uint64(64 - p)).astype(np.int64)
                    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
                    b = [_packed(first[i:j], last[i:j], n[i:j], ends[i:j]) for i, j in zip(cuts, cuts[1:])]  # noqa: B905
                    yield pa.RecordBatch.from_pydict({"part": pa.array(of[cuts[:-1]]), "k": pa.array(np.full(len(b), k, np.int8)), "b": pa.array(b, pa.binary())})

            for batch in batches:
                for _, texts in gathered(batch.column("b")):
                    grams.of(texts)
                    for k, g, at in _worth(grams, bits):
                        at = at[((g[at] & low) >> shift) % np.uint64(slices) == slice_]
                        below = grams.all[k - 1] if k else g
                        held[k].append((g[at], below[at] if k else np.zeros(len(at), np.uint64), below[at + 1] if k else g[at], grams.last[at + k]))
                        size += len(at)
                    if size > 2 * _CHUNK:
                        yield from sent()
                        size = 0
            yield from sent()

        def summed(table: pa.Table) -> pa.Table:
            """The counts of a part."""
            rows, keep = {}, {}
            bits, ks = np.zeros(1 << int(shift), bool), np.array(table["k"])
            place = lambda g: (g & np.uint64(len(bits) - 1)).astype(np.int64)
            for k in range(1, order + 1):
                parts = [_unpacked(b) for b in table["b"].filter(pa.array(ks == k)).to_pylist()]
                if not parts:
                    continue
                first, last, n, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
                g = pair_hash(first, last) if k > 1 else last
                at, g = _ordered(g)
                new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                n = np.add.reduceat(n[at], new)
                rows[k] = g[new], first[at[new]], last[at[new]], n, n - np.add.reduceat(ends[at], new)
                keep[k] = (n >= least) | (k == 1)
                if k > 1:
                    bits[place(rows[k][0][keep[k]])] = True
            out = []
            for k, (g, first, last, n, ctx) in rows.items():
                at = np.flatnonzero(keep[k] | bits[place(g)] if marked else keep[k])
                cols = {"k": np.full(len(at), k, np.int8), "first": first[at].view(np.int64), "last": last[at].view(np.int64), "n": n[at], "ctx": ctx[at]}
                out.append(pa.table(cols | {"bits": pa.nulls(len(at), pa.binary())}))
            if marked:
                of, none = [table["part"][0].as_py()], pa.array([0], pa.int64())
                out.append(pa.table({"k": pa.array([0], pa.int8()), "first": pa.array(of, pa.int64()), "last": none, "n": none, "ctx": none, "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())}))
            return pa.concat_tables(out)

        marked = marks is not None
        rows = docs.select(utf8("text").alias("b")).mapInArrow(run, "part long, k byte, b binary")
        return stored(rows.groupBy("part").applyInArrow(summed, "k byte, first long, last long, n long, ctx long, bits binary"), "counts")

    return [part(s) for s in range(slices)]


def counted_bits(counts: DataFrame, bits: int) -> np.ndarray:
    """The 2^bits bits that count tables hold, set for every n-gram counted often enough."""
    with tidy(counts.sparkSession):
        rows = counts.where("k = 0").select("first", "bits").collect()  # 2^bits bits in all
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["first"] * len(r["bits"]) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def logs(parts: list[DataFrame], order: int, alpha: float, total: int, least: int) -> list[DataFrame]:
    """For each order a table gram, n, ctx, log: the logarithm of its score. A longer run finds
    what it needs of the order below by its first words if it is counted, by its last ones if it
    backs off. `parts` go once read."""
    counts = reduce(DataFrame.unionByName, parts)
    tables = [stored(counts.where("k = 1").select(F.col("last").alias("gram"), "n", "ctx", (F.log("n") - math.log(max(1, total))).alias("log")), "logs")]
    for k in range(2, order + 1):
        below = tables[-1].select(F.col("gram").alias("via"), F.col("ctx").alias("times"), F.col("log").alias("back"))
        rows = counts.where(F.col("k") == k).select(F.xxhash64("first", "last").alias("gram"), F.when(F.col("n") >= least, F.col("first")).otherwise(F.col("last")).alias("via"), "n", "ctx")
        log = F.when(F.col("n") >= least, F.log("n") - F.log("times")).otherwise(F.col("back") + math.log(alpha))
        tables.append(stored(rows.join(below.hint("shuffle_hash"), "via").select("gram", "n", *["ctx"] * (k < order), log.alias("log")), "logs"))
    dropped(*parts)
    return tables


def common_table(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms (gram, n, log) of common n-grams as keys and logarithms, in a table that
    n-grams find by their lowest bits. Of two that share these the more frequent is held; the
    other is joined like rare ones."""
    key, value = np.arange(1, (1 << 20) + 1, dtype=np.uint64), np.zeros(1 << 20)  # no n-gram finds these keys
    for gram, _, log in sorted(rows, key=lambda r: (r[1], -r[0])):
        at = gram % (1 << 20)
        key[at], value[at] = gram % 2**64, log
    return key, value


def find(table: tuple[np.ndarray, np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `g` are held, and the logarithms of these."""
    key, value = table
    at = (g & np.uint64(len(key) - 1)).astype(np.int64)
    held = key[at] == g
    return held, value[at[held]]


def longest(grams: Grams, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram that ends at each word and is in the tables, and its words."""
    top, depth = grams.all[0].copy(), np.ones(len(grams.all[0]), np.int64)
    for k, g, at in _worth(grams, bits):
        if k:  # each one's last words are in the tables too
            top[at + k], depth[at + k] = g[at], k + 1
    return top, depth


def score(docs: DataFrame, alpha: float = 0.4, least: int = 2, order: int = 3, bits: int = 28, slices: int = 2) -> DataFrame:
    """Stupid-backoff scores of each row's whole text under the counts of all rows: doc_id,
    n_words, log_score (natural logarithm), mean_log (of a word; null without words).

    Null and empty texts have 0 words and score 0. Repeated rows count and are scored each;
    null ids are scored like others; other columns are left out. `order`: words of the longest
    runs counted, 1 or more. Words and runs are known by 64-bit hashes. `bits`: the broadcast
    tables of n-grams that stand twice have 2^bits bits; `slices`: passes over the texts, by which
    the disk that shuffles need divides. Neither changes a score. Logarithms are the hashed side
    of the joins: a shuffle partition's share of them, some 50 bytes each, must fit in memory."""
    if order < 1 or least < 1:
        raise ValueError("order and least: 1 or more")
    spark = docs.sparkSession
    with small_batches(spark):
        size = _size(docs)
        marks = spark.sparkContext.broadcast(repeated(docs, order, bits, size)) if least > 1 and order > 1 else None
        parts = gram_counts(docs, order, least, marks, slices, size)
    counts = reduce(DataFrame.unionByName, parts)
    if marks:
        marks.unpersist()
        marks = spark.sparkContext.broadcast(counted_bits(counts, bits))
    with tidy(spark):
        total = counts.where("k = 1").agg(F.sum("n")).first()[0] or 0
    tables = logs(parts, order, alpha, total, least)
    floor = max(least, total // _SHARE, _OFTEN)
    with tidy(spark):
        often = [r for t in tables for r in t.where(F.col("n") >= floor).select("gram", "n", "log").collect()]  # 2^19 of each order at most, and far fewer in any language
    common = spark.sparkContext.broadcast(common_table(often))
    known_logs = reduce(DataFrame.unionByName, [t.select("gram", "log") for t in tables])
    texts = docs.select("doc_id", utf8("text").alias("b")).withColumn("key", F.xxhash64("b"))
    kind = pa.struct([("n", pa.int64()), ("s", pa.float64())])

    def exploded(slice_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, table, bits = Grams(order), common.value, marks.value if marks else None
            for batch in batches:
                keys = batch.column("key").to_numpy()
                for first, texts in gathered(batch.column("b")):
                    grams.of(texts)
                    top, depth = longest(grams, bits)
                    mine = keys[first : first + len(texts)]
                    if slice_ == 0:
                        held, log = find(table, top)
                        most = sum(np.maximum(grams.n - k, 0) for k in range(order))  # words of the longest runs there could be
                        s = math.log(alpha) * (most - np.bincount(grams.text, depth, len(texts))) + np.bincount(grams.text[held], log, len(texts))
                        own = pa.StructArray.from_arrays([pa.array(grams.n, pa.int64()), pa.array(s)], names=["n", "s"])
                        spread = mine.view(np.uint64) + np.arange(len(mine), dtype=np.uint64)  # copies go to different tasks
                        yield pa.RecordBatch.from_pydict({"gram": pa.array(spread.view(np.int64)), "key": pa.array(mine), "own": own})
                        at = np.flatnonzero((top % np.uint64(slices) == slice_) & ~held)
                    else:
                        at = np.flatnonzero(top % np.uint64(slices) == slice_)
                        at = at[~find(table, top[at])[0]]
                    for rows in _batches(gram=top[at], key=mine[grams.text[at]]):
                        yield rows.append_column("own", pa.nulls(rows.num_rows, kind)) if slice_ == 0 else rows

        return run

    sums = []
    with small_batches(spark):
        for j in range(slices):
            rows = texts.select("b", "key").mapInArrow(exploded(j), "gram long, key long" + ", own struct<n: long, s: double>" * (j == 0))
            mine = known_logs.where(F.expr(_umod("gram", slices)) == j).hint("shuffle_hash")
            if j == 0:  # the texts' own rows meet no n-gram, or one that they do not heed
                added = rows.join(mine, "gram", "left").groupBy("key").agg(F.sum(F.coalesce("own.s", "log")).alias("g"), F.sum("own.n").alias("n"), F.count("own.n").alias("copies"))
            else:
                added = rows.join(mine, "gram").groupBy("key").agg(F.sum("log").alias("g"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("copies"))
            sums.append(stored(added, "sums"))
    dropped(*tables)
    added = reduce(DataFrame.unionByName, sums).groupBy("key").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    added = stored(added.select("key", F.expr("n div copies").alias("n_words"), (F.col("g") / F.col("copies")).alias("log_score")), "added")  # equal texts sent equal rows
    dropped(*sums)
    out = texts.select("doc_id", "key").join(added, "key").select("doc_id", "n_words", "log_score")
    return out.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def _umod(col: str, parts: int) -> str:
    """SQL for an unsigned 64-bit remainder of a long column."""
    shift = 2**64 % parts
    return f"case when {col} >= 0 then {col} % {parts} else pmod({col} % {parts} + {shift}, {parts}) end"
