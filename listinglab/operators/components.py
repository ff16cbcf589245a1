"""Connected components of an edge table, by contraction."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored


def _rank(node: str, seed: int) -> Column:
    """A node's place in a round's random order; ties of hashes go by the node itself."""
    return F.struct(F.xxhash64(F.col(node), F.lit(seed)).alias("h"), F.col(node).alias("v"))


def _between(edges: DataFrame) -> DataFrame:
    """Each edge once, the lesser end first; loops and null ends are no edges."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contracted(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round, of edges (a, b) that stand once: (node, to) of every node on an edge, `to`
    being the first of the node and its neighbours in the round's random order, and the edges
    between what their ends went to. Nodes stay connected just as before: an edge that a node
    went along becomes one from there to where its other end went. A connected part that went
    to one node has no edges any more."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("o")), F.struct(F.col("b").alias("node"), F.col("a").alias("o")))).alias("e")).select("e.*")
    first = ends.groupBy("node").agg(F.min(_rank("o", seed)).alias("near"))
    moves = stored(first.select("node", F.least("near", _rank("node", seed))["v"].alias("to")), "moves")
    at = lambda end: moves.select(F.col("node").alias(end), F.col("to").alias(f"_{end}"))
    moved = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return moves, stored(_between(moved), "edges")


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) of an edge table (a, b), root being the least node reachable. Each round
    contracts the edges (see `contracted`), so that their number falls from round to round and
    finished components leave. Two rounds share an order: a hub goes to the first of its leaves in one, and
    its other leaves, which are that one's neighbours then, in the next. Where nodes went is then followed back from the last round to the first. Rows with a null end, or with
    equal ends, are no edges; repeated ones are one; no edges give no rows. Only whether edges
    are left reaches the driver. A hub of many edges is pre-aggregated before the shuffle that
    ranks its neighbours, and split by the adaptive skew join where edges meet the moves."""
    edges, rounds = stored(_between(pairs.select("a", "b")), "edges"), []
    while edges.take(1):
        moves, left = contracted(edges, len(rounds) // 2)
        dropped(edges)
        edges = left
        rounds.append(moves)
    dropped(edges)
    if not rounds:
        return stored(pairs.selectExpr("a as node", "a as root").limit(0), "roots")
    ends = rounds.pop()
    while rounds:  # a later round has fewer nodes than all that it is joined to
        moves = rounds.pop()
        later = ends.toDF("to", "end")
        joined = stored(moves.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")), "moves")
        dropped(moves, ends)
        ends = joined
    least = ends.groupBy("to").agg(F.min("node").alias("root"))
    out = stored(ends.join(least, "to").select("node", "root"), "roots")
    dropped(ends)
    return out

