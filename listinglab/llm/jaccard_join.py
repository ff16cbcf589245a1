"""N-gram Jaccard join: a size-aware heavy-light join of the word shingles of whole texts.

Equal sets are one class from the start. Pairs of small sets meet on enumerated subsets: sets
of a and b shingles link if and only if they share a subset of c(a, b), the least overlap that
the threshold asks of those sizes. Pairs with a large set meet on inverted lists, of which only
prefixes in a rarest-first order need scanning. The boundary is where the rows of both sides
cost least.

Groups of near copies would make all their pairs on a list. So lists are scanned in two turns:
first each set meets a few leaders of its lists and is compared with those it shares most with;
then, what links being merged, all pairs of different components are compared.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored, tidy
from .common import Words, components, mix, small_batches, utf8

_SIZE = 5  # words of a shingle
_K = np.uint64(0x9E3779B97F4A7C15)
_WHOLE = 24  # sets up to this size are kept whole; the boundary is at or below it
_CHUNK = 15  # log2 of counters in one row of the sketch
_BITS = 26  # log2 of the bits that mark shared shingles


class Shingler:
    """64-bit hashes of the distinct shingles of a text, sorted: all runs of five words, or
    the whole of fewer. A-Z are lower-cased; words are parted by space and U+0009 to U+000D."""

    def __init__(self) -> None:
        self.words = Words()

    def __call__(self, text: bytes) -> np.ndarray:
        h = self.words(text)
        n = min(_SIZE, len(h))
        if not n:
            return h
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = out * _K + h[i : len(h) - n + 1 + i]
        return self.done(mix(out + np.uint64(_SIZE - n)))

    def done(self, hashes: np.ndarray) -> np.ndarray:
        return np.unique(hashes)


class AllShingles(Shingler):
    """The shingles of a text as often as they stand there, in order."""

    def done(self, hashes: np.ndarray) -> np.ndarray:
        return hashes


class Rule:
    """Two sets link if 100 * overlap >= percent * union."""

    def __init__(self, percent: int) -> None:
        self.p = percent

    def least(self, a, b):
        """Least overlap of linked sets of a and b shingles (also Spark columns' `div` below)."""
        return -(-self.p * (a + b) // (100 + self.p))

    def prefix(self, n):
        """Shingles of a set of n that lists need: with fewer shared ones none, some partner
        of any size is out of reach."""
        return n + 1 - (-(-self.p * n // 100))

    def partners(self, n: int) -> range:
        return range(-(-self.p * n // 100), 100 * n // self.p + 1)

    def bounds(self, most: int = 128) -> list[int]:
        """Least sizes of bands of sizes: partners of a set lie in its own band or the next."""
        out = [1]
        while len(out) < most:
            out.append(100 * out[-1] // self.p + 1)
        return out

    def least_sql(self, a: str, b: str) -> str:
        return f"(({self.p} * ({a} + {b}) + {99 + self.p}) div {100 + self.p})"


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def counted(docs: DataFrame, bits: int, hashes, packed) -> DataFrame:
    """Parts of a table of 2^bits counters over the hashes of all texts: chunk (a run of
    counters), n (`packed` of their counts). Tasks send their counters compressed."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, held, n = hashes(), np.zeros(size, np.uint16), [], 0

        def flush() -> None:
            at, c = np.unique((np.concatenate(held) & np.uint64(size - 1)).astype(np.int32), return_counts=True)
            counts[at] = np.minimum(counts[at] + c, 65535)

        for batch in batches:
            for b in batch.column("b"):
                held.append(of(b.as_py()))
                n += len(held[-1])
                if n > 1 << 18:
                    flush()
                    held, n = [], 0
        if n:
            flush()
        parts = counts.reshape(-1, 1 << min(_CHUNK, bits))
        some = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(some), 64):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(some[at : at + 64], pa.int64()), "n": pa.array([pa.compress(parts[i].tobytes(), codec="zstd", asbytes=True) for i in some[at : at + 64]], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << min(_CHUNK, bits), np.int64)
        for x in table["n"]:
            total += np.frombuffer(pa.decompress(x.as_py(), 2 * len(total), codec="zstd", asbytes=True), np.uint16)
        return pa.table({"chunk": table["chunk"][:1], "n": pa.array([packed(total)], pa.binary())})

    return docs.select(utf8("text").alias("b")).mapInArrow(run, "chunk long, n binary").groupBy("chunk").applyInArrow(add, "chunk long, n binary")


def frequency_codes(docs: DataFrame, bits: int) -> np.ndarray:
    """How often shingles fall in each of 2^bits counters, as one byte on a scale of six steps
    to a doubling: a table of fixed size. It only orders shingles: any codes give the same
    links, good ones less work."""

    def code(counts: np.ndarray) -> bytes:
        return pa.compress((6 * np.log2(1 + np.minimum(counts, 2**32).astype(np.float64))).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)

    codes = np.zeros(1 << bits, np.uint8).reshape(-1, 1 << min(_CHUNK, bits))
    with tidy(docs.sparkSession):
        rows = counted(docs, bits, AllShingles, code).collect()  # 2^bits bytes in all
    for r in rows:
        codes[r["chunk"]] = np.frombuffer(pa.decompress(bytes(r["n"]), codes.shape[1], codec="zstd", asbytes=True), np.uint8)
    return codes.reshape(-1)


def row_key(docs: DataFrame) -> Column:
    """What a row is found by: a hash of its id, or of its text if the id is null. Rows of one
    key are told apart by their sets."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(utf8("text"))).alias("key")


def odd_sketch(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each of m bits, m being the power of two from the
    set's size up (64 at least). Bits that differ between two sketches each need a shingle that
    only one set has. A sketch of 2m bits folds to one of m."""
    m = 64 if len(s) <= 64 else 1 << (len(s) - 1).bit_length()
    return np.packbits((np.bincount(((s * _K) >> np.uint64(32)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(bool), bitorder="little").tobytes()


def most_shared(a: int, b: int, x: bytes, y: bytes) -> int:
    """An upper bound of the overlap of two sets of a and b shingles, from their sketches."""
    u, v = (np.frombuffer(z, np.uint64) for z in (x, y))
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return (a + b - int(np.bitwise_count(u ^ v).sum())) // 2


def signatures(docs: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Each row's set: doc_id, key (see `row_key`), n (its size), class (hash of the set),
    sketch (see `odd_sketch`), tokens (its rarest shingles in order, as many as lists need; of
    a small set all)."""
    spark = docs.sparkSession
    codes = spark.sparkContext.broadcast(frequency_codes(docs, bits))  # 2^bits bytes
    kind, mask = docs.schema["doc_id"].dataType.simpleString(), np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order = Shingler(), codes.value
        for batch in batches:
            ns, classes, tokens, sketches = [], [], [], []
            for b in batch.column("b"):
                s = shingles(b.as_py())
                n = len(s)
                ns.append(n)
                classes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sketches.append(odd_sketch(s))
                key = (order[(s & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                ranked = s[np.argsort(key, kind="stable")]
                tokens.append((ranked if n <= _WHOLE else ranked[: rule.prefix(n)]).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(ns, pa.int64()), _signed(np.array(classes, np.uint64)), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "key", "n", "class", "sketch", "tokens"])

    out = stored(docs.select("doc_id", row_key(docs), utf8("text").alias("b")).mapInArrow(run, f"doc_id {kind}, key long, n long, class long, sketch binary, tokens array<long>"), "sets")
    codes.destroy()
    return out


def boundary(sets: DataFrame, rule: Rule, scan_cost: int = 4) -> int:
    """The size up to which enumerating subsets costs fewer rows than scanning lists, where a
    list's row counts `scan_cost` times, as its candidates must still be compared."""
    sizes = dict(sets.where(f"n between 1 and {2 * _WHOLE}").groupBy("n").count().collect())  # one row for each small size
    cost = {}
    for x in range(_WHOLE + 1):
        small = sum(m * sum(comb(n, rule.least(n, b)) for b in rule.partners(n) if b <= x) for n, m in sizes.items() if n <= x)
        cost[x] = small + scan_cost * sum(m * rule.prefix(n) for n, m in sizes.items() if 100 * n >= rule.p * (x + 1))
    return min(cost, key=lambda x: (cost[x], x))


def small_links(sets: DataFrame, rule: Rule, upto: int) -> DataFrame:
    """Links (a, b) that connect the classes of at most `upto` shingles as their pairs do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, highs, classes, same = [], [], [], []
            for n, c, t in zip(batch.column("n").to_pylist(), batch.column("class").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                t = sorted(t)
                for b in rule.partners(n):
                    if b <= upto:
                        seed = min(n, b) * 1000 + max(n, b)
                        for sub in combinations(t, rule.least(n, b)):
                            keys.append(xxhash.xxh3_64_intdigest(np.array(sub, np.int64).tobytes(), seed=seed))
                            highs.append(n > b)
                            classes.append(c)
                            same.append(n == b)
            yield pa.RecordBatch.from_arrays([_signed(np.array(keys, np.uint64)), pa.array(highs, pa.bool_()), pa.array(classes, pa.int64()), pa.array(same, pa.bool_())], names=["key", "high", "class", "same"])

    few = sets.where(f"n between 1 and {upto}").select("n", "class", "tokens")
    rows = stored(few.mapInArrow(run, "key long, high boolean, class long, same boolean").distinct(), "subsets")
    # A key stands for one pair of sizes: members of one size link with the other's least
    # class, or with their own if both sizes are equal.
    low, up = F.min(F.when(~F.col("high"), F.col("class"))), F.min(F.when(F.col("high"), F.col("class")))
    keys = rows.groupBy("key").agg(low.alias("low"), up.alias("up"))
    other = F.when(F.col("same") | F.col("high"), F.col("low")).otherwise(F.col("up"))
    return rows.join(keys, "key").select(F.col("class").alias("a"), other.alias("b")).where("b is not null and a <> b").distinct()


def shared_tokens(sets: DataFrame, rule: Rule) -> np.ndarray:
    """Bits that are set for every shingle that the prefixes of two or more classes hold (and
    for a few others). Each task sends a shingle, as 48 bits, with its least and greatest
    class, so one that a third of all sets hold is two rows of each batch."""
    with tidy(sets.sparkSession):
        entries = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    chunks = 1 << (_BITS - 16)
    turns = max(1, entries // (chunks << 13))  # groups of one chunk of bits: 8192 shingles each

    def ends(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        last = np.concatenate([first[1:], [len(token)]]) - 1
        return token[first], cls[first], cls[last]

    def planes(x: np.ndarray) -> np.ndarray:
        """The bytes of 32-bit integers, lowest bytes first: high ones of small numbers compress."""
        return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            h = mix(np.concatenate([t for t, _ in held]).view(np.uint64)) >> np.uint64(16)
            t, lo, hi = ends(h, np.concatenate([c for _, c in held]))
            two = lo != hi
            t, c = np.concatenate([t, t[two]]), np.concatenate([lo, hi[two]]).view(np.uint8).reshape(-1, 8)[:, :6]
            part = (t & np.uint64(chunks - 1)) * np.uint64(turns) + (t >> np.uint64(42)) % np.uint64(turns)
            low = (t >> np.uint64(_BITS - 16)) & np.uint64(0xFFFFFFFF)
            order = np.lexsort((low, part))
            part, low, c = part[order].astype(np.int64), low[order].astype(np.int64), c[order]
            some, cuts = np.unique(part, return_index=True)
            cuts = np.append(cuts, len(part))
            blobs = [len(x := low[i:j]).to_bytes(4, "little") + pa.compress(planes(np.diff(x, prepend=0)).tobytes(), codec="zstd", asbytes=True) for i, j in zip(cuts, cuts[1:])]  # noqa: B905
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary()), pa.array([c[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["part", "t", "c"])  # noqa: B905

        for batch in batches:
            col = batch.column("tokens")
            held.append((col.flatten().to_numpy(), np.repeat(batch.column("class").to_numpy(), np.diff(col.offsets.to_numpy()))))
            size += len(held[-1][0])
            if size > 1 << 20:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def shared(table: pa.Table) -> pa.Table:
        t, c = [], []
        for x, y in zip(table["t"].to_pylist(), table["c"].to_pylist(), strict=True):
            n = int.from_bytes(x[:4], "little")
            t.append(np.cumsum(np.ascontiguousarray(np.frombuffer(pa.decompress(x[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view(np.uint32).ravel(), dtype=np.int64))
            c.append(np.pad(np.frombuffer(y, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view(np.int64).ravel())
        t, lo, hi = ends(np.concatenate(t), np.concatenate(c))
        a = np.zeros(1 << 16, bool)
        a[t[lo != hi] & 0xFFFF] = True
        return pa.table({"chunk": pa.array([table["part"][0].as_py() // turns]), "b": pa.array([np.packbits(a).tobytes()], pa.binary())})

    def joined(table: pa.Table) -> pa.Table:
        a = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["b"].to_pylist()])
        return pa.table({"chunk": table["chunk"][:1], "b": pa.array([a.tobytes()], pa.binary())})

    out = np.zeros((chunks, 1 << 13), np.uint8)
    with tidy(sets.sparkSession):
        rows = sets.select("class", "tokens").mapInArrow(pack, "part long, t binary, c binary").groupBy("part").applyInArrow(shared, "chunk long, b binary")
        if turns > 1:
            rows = rows.groupBy("chunk").applyInArrow(joined, "chunk long, b binary")
        rows = rows.collect()  # 2^_BITS bits in all
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["b"], np.uint8)
    return out.reshape(-1)


def _bit_of(tokens: np.ndarray) -> np.ndarray:
    """Where `shared_tokens` has the bit of a shingle."""
    h = mix(tokens.view(np.uint64)) >> np.uint64(16)
    chunk = h & np.uint64((1 << (_BITS - 16)) - 1)
    return ((chunk << np.uint64(16)) | ((h >> np.uint64(_BITS - 16)) & np.uint64(0xFFFF))).astype(np.int64)


def list_rows(sets: DataFrame, rule: Rule, marked: np.ndarray) -> DataFrame:
    """The inverted lists' rows that can make pairs: token, class, n, pos (place in the order)."""
    held = sets.sparkSession.sparkContext.broadcast(marked)  # 2^_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            col = batch.column("tokens")
            flat, sizes = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
            at = _bit_of(flat)
            keep = (b[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            cls = np.repeat(batch.column("class").to_numpy(), sizes)
            keep &= pos < n + 1 - (rule.p * n + 99) // 100
            where = np.flatnonzero(keep)
            for i in range(0, len(where), 20_000):
                w = where[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[w], pa.int64()) for x in (flat, cls, n, pos)], names=["token", "class", "n", "pos"])

    rows = sets.select("class", "n", "tokens").mapInArrow(run, "token long, class long, n long, pos long")
    out = stored(rows.groupBy("token", "class").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "lists")
    held.destroy()
    return out


def _candidates(met: DataFrame, rule: Rule, upto: int) -> DataFrame:
    """Pairs (a, b) of `met` (a, an, ai, b, bn, bi: one row for each shared shingle of the two
    prefixes) that sizes, places and the number of shared shingles allow, with `shared`."""
    need = rule.least_sql("an", "bn")
    fits = f"100 * least(an, bn) >= {rule.p} * greatest(an, bn) and greatest(an, bn) > {upto}"
    pairs = met.where(fits).groupBy("a", "b", "an", "bn").agg(F.count("*").alias("shared"), F.max(F.expr(f"ai <= an - {need} and bi <= bn - {need}")).alias("near"))
    rest = f"greatest(({rule.p} * an + 99) div 100, ({rule.p} * bn + 99) div 100) - 1"  # behind either prefix
    return pairs.where(f"near and shared + {rest} >= {need}").select("a", "b", "shared")


def _wanted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (class, b: the text's bytes) of `docs` whose key is in `keys`, and a few others:
    a table of 2^23 bits keeps most texts from being shuffled. The class is the text's own."""
    size = 1 << 23

    def bits(table: pa.Table) -> pa.Table:
        a = np.zeros(1 << 16, bool)
        a[table["at"].to_numpy() & 0xFFFF] = True
        return pa.table({"chunk": table["chunk"][:1], "b": pa.array([np.packbits(a).tobytes()], pa.binary())})

    at = F.pmod("key", F.lit(size)).alias("at")
    marked = np.zeros((size >> 16, 1 << 13), np.uint8)
    with tidy(docs.sparkSession):
        rows = keys.select(at).distinct().withColumn("chunk", F.shiftright("at", 16)).groupBy("chunk").applyInArrow(bits, "chunk long, b binary").collect()  # 1 MB in all
    for r in rows:
        marked[r["chunk"]] = np.frombuffer(r["b"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(marked.reshape(-1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shingles = held.value, Shingler()
        for batch in batches:
            i = batch.column("key").to_numpy() & (size - 1)
            hit = (m[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1
            if hit.any():
                texts = batch.column("b").filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([_signed(np.array([xxhash.xxh3_64_intdigest(shingles(b.as_py()).tobytes()) for b in texts], np.uint64)), texts], names=["class", "b"])

    return docs.select(row_key(docs), utf8("text").alias("b")).mapInArrow(keep, "class long, b binary")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The `pairs` (a, b) of classes that link. Sketches rule out most others; what they leave
    is compared by whole texts."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    reps = stored(sets.select("class", "key", "n", "sketch").join(named, "class").groupBy("class").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "named")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = zip(*(batch.column(c).to_pylist() for c in ("m", "n", "x", "y")), strict=True)
            keep = [most_shared(m, n, x, y) >= rule.least(m, n) for m, n, x, y in cols]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = reps.selectExpr("class as a", "n as m", "sketch as x"), reps.selectExpr("class as b", "n", "sketch as y")
    likely = stored(pairs.join(y, "b").join(x, "a").select("a", "b", "m", "n", "x", "y").mapInArrow(possible, "a long, b long"), "likely")
    keys = stored(reps.select("class", "key").join(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class"), "keys")
    dropped(pairs, reps)
    # One text for each class: rows of the same key and other texts are of another class.
    texts = stored(_wanted(docs, keys).join(keys.select("class"), "class", "left_semi").dropDuplicates(["class"]), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            keep, last, x = [], None, None
            for a, s, t in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last:
                    last, x = a, shingles(s.as_py())
                y = shingles(t.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= rule.p * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
    out = stored(likely.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")
    dropped(likely, keys, texts)
    return out


def _sides(rows: DataFrame, tag: str) -> DataFrame:
    own = [c for c in ("token", "band") if c in rows.columns]
    return rows.select(*own, *[F.col(c).alias(tag + to) for c, to in (("class", ""), ("n", "n"), ("pos", "i"), ("comp", "c")) if c in rows.columns])


def _leader_pairs(rows: DataFrame, rule: Rule, upto: int, leaders: int, picks: int) -> DataFrame:
    """Pairs to compare: each class with those `picks` leaders of its lists that it shares most
    with. A list's leaders are the sets where its shingle stands first: they hold least of
    their own besides what a group shares, so the group's other members link with them if with
    any. The pairs are a fixed number for each class, however long a list is."""
    first = Window.partitionBy("token").orderBy("pos", "class")
    chosen = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= leaders)
    met = _sides(rows, "a").join(_sides(chosen, "b"), "token").where("a <> b")
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    pairs = _candidates(met, rule, upto).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= picks)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_components(docs: DataFrame, percent: int = 75, sketch_bits: int = 24, leaders: int = 3, picks: int = 2) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (see `signatures`) and the components (node, component) of those
    classes that link with another. After the comparison with leaders, all pairs of different
    components that the lists allow are compared: nothing is missed."""
    with small_batches(docs.sparkSession):
        return _components_of(docs, Rule(percent), sketch_bits, leaders, picks)


def _components_of(docs: DataFrame, rule: Rule, sketch_bits: int, leaders: int, picks: int) -> tuple[DataFrame, DataFrame]:
    sets = signatures(docs, rule, sketch_bits)
    upto = boundary(sets, rule)
    large = sets.where(f"100 * n >= {rule.p * (upto + 1)}")
    lists = list_rows(large, rule, shared_tokens(large, rule))
    links = stored(small_links(sets, rule, upto).union(verified(_leader_pairs(lists, rule, upto, leaders, picks), docs, sets, rule)), "links")
    found = components(links)
    # What links being merged, only lists that several components stand on can say more.
    placed = stored(lists.join(found.toDF("class", "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class")), "placed")
    dropped(lists)
    open_ = placed.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("token")
    rows = stored(placed.join(open_, "token"), "open")
    dropped(placed)
    more = verified(_open_pairs(rows, rule, upto), docs, sets, rule)
    dropped(rows)
    return sets, components(links.union(more)) if more.take(1) else found


def _open_pairs(rows: DataFrame, rule: Rule, upto: int) -> DataFrame:
    """Pairs of classes of different components that a list, their sizes and places allow. The
    smaller set seeks partners in its own band of sizes and the next, so a list that very many
    sets stand on is dealt out by size."""
    need = rule.least_sql("an", "bn")
    banded = rows.withColumn("band", F.expr(f"size(filter(array({', '.join(map(str, rule.bounds()))}), x -> x <= n))"))
    a = _sides(banded.withColumn("band", F.explode(F.array("band", F.col("band") + 1))), "a")
    met = a.join(_sides(banded, "b"), ["token", "band"]).where(f"(an < bn or an = bn and a < b) and ac <> bc and 100 * an >= {rule.p} * bn and bn > {upto} and ai <= an - {need} and bi <= bn - {need}")
    return met.select("a", "b").distinct()


def link_documents(docs: DataFrame, percent: int = 75, sketch_bits: int = 24) -> DataFrame:
    """Near duplicates of `docs` (doc_id, text): doc_id, n_shingles, component_id for each
    row. Two rows link if 100 * overlap >= percent * union of their sets of five-word
    shingles; component_id is the smallest doc_id reachable by links, its own included.

    Null and empty texts have no shingles and link with nothing. Texts of fewer than five
    words are one shingle. Repeated rows are rows of one class; rows with the same id and
    other texts are judged by their texts. A null id is never a component's name unless all
    of it is null. Shingles are compared as 64-bit hashes."""
    sets, found = class_components(docs, percent, sketch_bits)
    rows = stored(_labelled(sets, found).select("doc_id", "n", "label"), "labelled")
    names = stored(rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "names")
    dropped(sets)
    named = rows.where("n > 0").join(names, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n, class of each row, and label: its component, or else its class."""
    return sets.select("doc_id", "n", "class").join(found.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))


def _with_class(docs: DataFrame) -> DataFrame:
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sets = [shingles(b.as_py()) for b in batch.column("__b")]
            cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), _signed(cls), pa.array([len(s) for s in sets], pa.int64())], names=[*own, "__class", "__n"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    return docs.withColumn("__b", utf8("text")).mapInArrow(run, f"{kinds}__class long, __n long")


def keep_one(docs: DataFrame, percent: int = 75, sketch_bits: int = 24) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id. Rows without words
    and rows with a null id all stay; of rows repeated with the same id and set one stays."""
    sets, found = class_components(docs, percent, sketch_bits)
    rows = stored(_labelled(sets.where("n > 0 and doc_id is not null"), found).select("doc_id", "class", "label"), "labelled")
    dropped(sets)
    least = stored(rows.groupBy("label").agg(F.min("doc_id").alias("kept")), "least")
    gone = stored(rows.join(least, "label").where("doc_id <> kept").select("doc_id", "class").distinct(), "gone")
    if not rows.groupBy("doc_id").count().where("count > 1").take(1):
        return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Some ids stand for several rows: each row is known by its id and its set.
    named = _with_class(docs)
    fixed = (F.col("__n") == 0) | F.col("doc_id").isNull()
    once = named.where(~fixed).join(gone.withColumnRenamed("class", "__class"), ["doc_id", "__class"], "left_anti").dropDuplicates(["doc_id", "__class"])
    # One component may also hold several sets of its smallest id: the least set stays.
    label = rows.join(least, "label").where("doc_id = kept").groupBy("label", "doc_id").agg(F.min("class").alias("__class")).select("doc_id", "__class")
    return once.join(label, ["doc_id", "__class"], "left_semi").unionByName(named.where(fixed)).select(*docs.columns)
