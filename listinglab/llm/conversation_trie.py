"""The prefix trie of conversations, from sorted sequences and range minima.

A conversation is the sequence of its turns' digests (16 bytes a turn). The distinct sequences
are sorted, and the turns that neighbours have in common (LCPs) are counted. A prefix of depth
d of the ith sequence is shared by just those around it between which no LCP is below d: two
binary searches over a sparse table of range minima give that interval's left and right end,
for every prefix by itself. A prefix that is the leftmost of its interval is a node; counts
and sums over its members, children and subtree are differences of running sums.

A partition of the range sort is a block with a sparse table of its own. Nodes that reach over
a block's border are its seam: at most as many as the sequences on both sides of the border
have turns in common. A second sparse table, over the blocks, finds the block they begin in.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored

TURN = 16  # bytes of a turn's digest
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FAR = np.int64(2**62)  # an LCP where none bounds


# -- sequences -------------------------------------------------------------------------------


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, words>>) of `turns` (conv_id, turn, role, text), in
    order of `turn`, null first; ties by the first 64 characters of role, then of text, then by
    digest. Null roles and texts are empty; rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    key = F.struct("turn", F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(key)).alias("s"))
    return rows.select("conv_id", F.transform("s", lambda x: F.struct(x.digest.alias("digest"), x.words.alias("words"))).alias("turns"))


def forked(seqs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """`seqs` in which each conversation c begins with the first h turns of conversation
    c - c % family (all if fewer, none if there is none), followed by its own after its first h;
    h is crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = seqs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head")) if most > 1 else seqs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 0).alias("head"))
    own = seqs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.select("conv_id", F.concat(head, rest).alias("turns"))


def _keyed(seqs: DataFrame) -> DataFrame:
    key: Column = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), ""))
    return seqs.select("conv_id", key.alias("key"), F.col("turns.words").alias("words")).withColumn("uid", F.md5("key"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (uid, conv_id) in order: each uid's least id, number of ids, and hash of them."""
    at, first, n, sha = None, 0, 0, None
    for batch in batches:
        uids, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        if not len(ids):
            continue
        cuts = [0, *(np.flatnonzero(uids[1:] != uids[:-1]) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if uids[a] != at:
                if n:
                    out.append((at, first, n, sha.hexdigest()))
                at, first, n, sha = uids[a], int(ids[a]), 0, hashlib.sha256()
            sha.update((("," if n else "") + ",".join(map(str, ids[a:b].tolist()))).encode())
            n += b - a
        yield _table(out)
    if n:
        yield _table([(at, first, n, sha.hexdigest())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["uid", "conv_id", "copies", "ends"])


def shared_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two sequences have in common."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    x, y = (np.frombuffer(s, np.uint64, 2 * n) for s in (a, b))
    return int(np.argmax(x != y)) // 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their block, place, and LCP with the row before (0 for the first)."""
    block, place, before = TaskContext.get().partitionId(), 0, b""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        lcp = [shared_turns(a, b) for a, b in zip([before, *keys], keys, strict=False)]
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int32()), pa.array(np.arange(place, place + n), pa.int64()), pa.array(lcp, pa.int64()), *batch.columns], ["block", "place", "lcp", *batch.schema.names])
        place, before = place + n, keys[-1] if keys else before


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cross = [-1 if x is None else shared_turns(x, y) for x, y in zip(b.column("before").to_pylist(), b.column("first").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("inner"), pa.array(cross, pa.int64())], ["block", "inner", "cross"])


# -- range minima ----------------------------------------------------------------------------


def minima(values: np.ndarray) -> list[np.ndarray]:
    """A sparse table: level j holds the minimum of the 2^j values from each place on."""
    out = [values]
    while len(out[-1]) > 1 << (len(out) - 1):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def reach_right(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How far each place p can move on while the values p, p + 1, ... are `least` or more."""
    at = at.copy()
    for j in range(len(table) - 1, -1, -1):
        level = table[j]
        ok = np.flatnonzero(at < len(level))
        ok = ok[level[at[ok]] >= least[ok]]
        at[ok] += 1 << j
    return at


def reach_left(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How far each place p can move back while the values p - 1, p - 2, ... are `least` or more."""
    at = at.copy()
    for j in range(len(table) - 1, -1, -1):
        level, back = table[j], at - (1 << j)
        ok = np.flatnonzero((back >= 0) & (back < len(level)))
        ok = ok[level[back[ok]] >= least[ok]]
        at[ok] -= 1 << j
    return at


def range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value from `left` to `right`, both included."""
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for j in np.unique(k):
        i = np.flatnonzero(k == j)
        out[i] = np.minimum(table[j][left[i]], table[j][right[i] - (1 << int(j)) + 1])
    return out


# -- nodes -----------------------------------------------------------------------------------

_PART = "owner int, depth long, inside boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, parent_owner int, parent_conv_id long"


def block_nodes(block: pa.Table, at: int, cross: int, beyond: int, before: list[np.ndarray]) -> pa.Table:
    """The nodes of one block, and what it holds of those that reach over its borders.

    at: the block's number; cross, beyond: LCPs over its left and right border (-1: none);
    before: sparse table of the deepest prefix that reaches from the right border of block 1, 2,
    ... over its left one."""
    block = block.sort_by("place")
    length = pa.compute.binary_length(block["key"]).to_numpy().astype(np.int64) // TURN
    copies, ids = block["copies"].to_numpy(), block["conv_id"].to_numpy()
    m = len(length)
    start = np.concatenate([[0], np.cumsum(length + 1)])  # of each row's prefixes, the empty one first
    row = np.repeat(np.arange(m), length + 1)
    depth = np.arange(start[-1]) - start[row]
    table = minima(block["lcp"].to_numpy()[1:])
    left, right = reach_left(table, row, depth), reach_right(table, row, depth)
    from_left, to_right = (left == 0) & (depth <= cross), (right == m - 1) & (depth <= beyond)
    node = left == row
    inside = node & ~from_left & ~to_right
    words = np.zeros(len(row), np.int64)
    words[depth > 0] = block["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    running = np.concatenate([[0], np.cumsum(copies)])
    n = running[right + 1] - running[left]
    least = range_min(minima(ids), left, right)
    above = np.arange(len(row)) - 1  # a prefix's parent among its own row's prefixes
    above[0] = 0
    parent = start[left[above]] + depth[above]  # that parent as a node of this block
    begun = np.flatnonzero(node & ~from_left & (depth > 0))
    children = np.bincount(parent[begun], minlength=len(row))
    leaf = inside & (children == 0)

    def below(each: np.ndarray) -> np.ndarray:  # sums over subtrees: a subtree is one run of prefixes
        total = np.concatenate([[0], np.cumsum(each)])
        return total[start[right + 1]] - total[np.arange(len(row))]

    saved, leaves = below(np.where(inside, (n - 1) * words, 0)), below(leaf)
    owner = np.full(len(row), at)
    out_left = np.flatnonzero(from_left & node)
    owner[out_left] = reach_left(before, np.full(len(out_left), at - 1), depth[out_left])
    k = np.flatnonzero(node)
    top = depth[k] == 0
    open_above = ~top & (from_left | to_right)[parent[k]]
    ends = block["ends"].to_numpy(zero_copy_only=False)
    ended = depth[k] == length[row[k]]
    return pa.table(
        {
            "owner": pa.array(owner[k], pa.int32()),
            "depth": pa.array(depth[k]),
            "inside": pa.array(inside[k]),
            "conv_id": pa.array(least[k]),
            "n_convs": pa.array(n[k]),
            "n_children": pa.array(children[k], pa.int64()),
            "n_leaves": pa.array(leaves[k], pa.int64()),
            "saved_tokens": pa.array(saved[k], pa.int64()),
            "ends_sha256": pa.array(np.where(ended, ends[row[k]], None), pa.string()),
            "words": pa.array(words[k], pa.int64()),
            "parent_owner": pa.array(owner[parent[k]], pa.int32(), mask=~open_above | from_left[k]),
            "parent_conv_id": pa.array(least[parent[k]], pa.int64(), mask=top | open_above),
        }
    )


def _seam(parts: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the seam. Stood by (owner, depth) they are in preorder: a subtree is a node
    and those that follow it, as far as all are deeper."""
    s = parts.sort_values(["owner", "depth"]).reset_index(drop=True)
    own = ((s["n_convs"] - 1) * s["words"]).to_numpy()
    depth, total = s["depth"].to_numpy(), np.concatenate([[0], np.cumsum(own)])
    end = reach_right(minima(depth[1:]), np.arange(len(s)), depth + 1)
    s["saved_tokens"] += total[end + 1] - total[:-1]
    ids = {(o, d): c for o, d, c in zip(s["owner"], s["depth"], s["conv_id"], strict=True)}
    s["parent_conv_id"] = pd.array([None if d == 0 else ids[int(o), d - 1] for o, d in zip(s["parent_owner"], s["depth"], strict=True)], "Int64")
    return s


def trie(seqs: DataFrame, blocks: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of `seqs` (conv_id, turns array<struct<digest, words>>).

    Returns one row for each distinct prefix, the empty one included: conv_id (its least
    member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, each
    node's (n_convs - 1) times its last turn's words) and ends_sha256 (of the ids of members
    that end there, ascending, comma-joined).

    A conversation without turns belongs to the root. No conversations give no rows. Copies of
    a sequence are counted before it is sorted, so a large group of them is one row of a block;
    their ids pass one task as a stream, since the hash of them is one value. Other columns are
    left out. `blocks`: partitions of the sort (Spark's own number by default). Only the LCPs at
    the blocks' borders and the seam's nodes reach the driver. A conversation is one row here,
    of 20 bytes a turn."""
    spark = seqs.sparkSession
    rows = stored(_keyed(seqs), "sequences")
    copies = rows.select("uid", "conv_id").repartition("uid").sortWithinPartitions("uid", "conv_id").mapInArrow(_copies, "uid string, conv_id long, copies long, ends string")
    unique = rows.join(copies, ["uid", "conv_id"]).select("conv_id", "copies", "ends", "key", "words")
    by = [F.substring("key", 1, 256 * TURN)]
    ranged = unique.repartitionByRange(blocks, *by) if blocks else unique.repartitionByRange(*by)
    placed = stored(ranged.sortWithinPartitions("key").mapInArrow(_neighbours, "block int, place long, lcp long, " + ", ".join(f"{c} {t}" for c, t in ranged.dtypes)), "blocks")
    dropped(rows)
    edge = placed.groupBy("block").agg(F.min(F.when(F.col("place") > 0, F.col("lcp"))).alias("inner"), F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    edge = edge.withColumn("before", F.lag("last").over(Window.orderBy("block"))).drop("last")
    edges = edge.mapInArrow(_crossing, "block int, inner long, cross long").toPandas().sort_values("block")
    if edges.empty:
        dropped(placed)
        return spark.createDataFrame([], NODE)
    number = {b: k for k, b in enumerate(edges["block"])}
    cross = edges["cross"].to_numpy()
    beyond = np.append(cross[1:], -1)
    before = minima(np.minimum(cross, pd.to_numeric(edges["inner"]).fillna(_FAR).to_numpy().astype(np.int64))[1:])

    def nodes(block: pa.Table) -> pa.Table:
        b = number[block["block"][0].as_py()]
        return block_nodes(block, b, int(cross[b]), int(beyond[b]), before)

    parts = stored(placed.groupBy("block").applyInArrow(nodes, _PART), "nodes")
    dropped(placed)
    empty = hashlib.sha256(b"").hexdigest()
    out = parts.where("inside")
    seam = parts.where("not inside").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"), F.max("words").alias("words"), F.max("parent_owner").alias("parent_owner")).toPandas()
    columns = [c.split()[0] for c in NODE.split(", ")]
    if seam.empty:
        return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).select(*columns)
    done = _seam(seam)
    top = spark.createDataFrame(done[["owner", "depth", "conv_id"]].rename(columns={"owner": "parent_owner", "conv_id": "above"}).assign(depth=done["depth"] + 1), "parent_owner int, depth long, above long")
    under = out.where("parent_owner is not null").join(top, ["parent_owner", "depth"]).withColumn("parent_conv_id", F.col("above"))
    over = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in done[columns].astype(object).itertuples(index=False)], NODE)
    whole = out.where("parent_owner is null").select(*columns).unionByName(under.select(*columns)).unionByName(over)
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
