"""Components by contraction against a union of sets; edges fall from round to round."""

import random

from pyspark.sql import functions as F

from listinglab.operators.components import connected_components, contracted
from listinglab.sources.shared import dropped, stored


def brute(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {x: top(x) for x in parent}


def found(spark, edges, kind="long"):
    return {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()}


def test_random_graphs_loops_nulls_and_repeats(spark):
    rnd = random.Random(7)
    for n, m in ((40, 30), (60, 90)):
        edges = [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(m)]
        edges += edges[:5] + [(b, a) for a, b in edges[:5]] + [(None, 1), (2, None), (None, None), (999, 999)]
        got = found(spark, edges)
        assert got == brute(edges) and 999 not in got


def test_text_nodes_go_by_their_order(spark):
    edges = [("b", "a"), ("b", "c"), ("z", "y"), ("", "z")]
    assert found(spark, edges, "string") == {"a": "a", "b": "a", "c": "a", "y": "", "z": "", "": ""}


def test_no_edges_give_no_rows(spark):
    for rows in ([], [(1, 1), (None, 2)]):
        out = connected_components(spark.createDataFrame(rows, "a long, b long"))
        assert out.columns == ["node", "root"] and out.collect() == []


def _rounds(edges):
    sizes, edges = [edges.count()], stored(edges, "edges")
    while sizes[-1]:
        moves, left = contracted(edges, (len(sizes) - 1) // 2)
        dropped(edges, moves)
        edges = left
        sizes.append(edges.count())
    dropped(edges)
    return sizes


def test_a_star_of_a_million_edges_shrinks_at_once(spark):
    star = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    sizes = _rounds(star)
    assert len(sizes) <= 3 and sizes == sorted(set(sizes), reverse=True)
    assert connected_components(star).groupBy("root").count().collect() == [(0, 1_000_001)]


def test_a_chain_halves(spark):
    n = 20_000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    sizes = _rounds(chain)
    assert all(y < 0.4 * x for x, y in zip(sizes, sizes[2:], strict=False) if x > 500)
    assert sizes == sorted(set(sizes), reverse=True)
    assert connected_components(chain).groupBy("root").count().collect() == [(0, n + 1)]


def test_finished_components_leave(spark):
    """Many couples beside a chain: the couples are gone after a round."""
    couples = spark.range(10_000).select((F.col("id") * 2 + 1_000_000).alias("a"), (F.col("id") * 2 + 1_000_001).alias("b"))
    chain = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert _rounds(couples.union(chain))[1] < 100
