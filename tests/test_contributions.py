"""Exact contributions of trees against enumeration of all subsets of features."""

import itertools
import math
import time

import numpy as np
import pytest

from listinglab.operators import model


def grown(rng, depth, features):
    """A random tree, with covers of random training rows."""
    left, right, feature, at, sets, value, cover = [], [], [], [], [], [], []

    def grow(level, n):
        k = len(left)
        for column, x in ((left, -1), (right, -1), (feature, -1), (at, 0.0), (sets, 0), (value, rng.normal()), (cover, n)):
            column.append(x)
        if level and n > 1:
            f = int(rng.integers(features))
            feature[k] = f
            if f == 0:
                sets[k] = int(rng.integers(1, 15))
            else:
                at[k] = float(rng.normal())
            part = int(rng.integers(1, n))
            left[k] = grow(level - 1, part)
            right[k] = grow(level - 1, n - part)
        return k

    grow(depth, 1000)
    return {"left": np.array(left), "right": np.array(right), "feature": np.array(feature), "at": np.array(at), "set": np.array(sets, np.uint64), "value": np.array(value), "cover": np.array(cover)}


def expected(t, x, known, node=0):
    if t["left"][node] < 0:
        return t["value"][node]
    f, kids = t["feature"][node], (t["left"][node], t["right"][node])
    if f in known:
        goes = (int(t["set"][node]) >> int(x[f])) & 1 if t["set"][node] else x[f] <= t["at"][node]
        return expected(t, x, known, kids[0] if goes else kids[1])
    return sum(expected(t, x, known, k) * t["cover"][k] for k in kids) / t["cover"][node]


def brute(t, x):
    m = len(x)
    out = np.zeros(m + 1)
    out[-1] = expected(t, x, ())
    for j in range(m):
        rest = [f for f in range(m) if f != j]
        for size in range(m):
            for s in itertools.combinations(rest, size):
                out[j] += math.factorial(size) * math.factorial(m - 1 - size) / math.factorial(m) * (expected(t, x, (*s, j)) - expected(t, x, s))
    return out


@pytest.mark.parametrize("seed, depth", [(1, 0), (2, 1), (3, 3), (4, 5), (5, 6)])
def test_contributions_equal_enumeration(seed, depth):
    rng = np.random.default_rng(seed)
    trees = [(w, t := grown(rng, depth, 5), model.leaf_paths(t)) for w in (1.0, 0.1, -0.5)]
    x = np.column_stack([rng.integers(0, 5, 40), rng.normal(size=(40, 4))]).astype(float)
    got = model.contributions(x, trees)
    want = np.array([sum(w * brute(t, row) for w, t, _ in trees) for row in x])
    assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(got.sum(axis=1), [sum(w * expected(t, row, range(5)) for w, t, _ in trees) for row in x])
    assert model.contributions(x[:0], trees).shape == (0, 6)


def test_deep_paths_take_no_subsets():
    """A path of 40 features: 2^40 subsets, 1,600 steps."""
    rng = np.random.default_rng(1)
    shares = rng.uniform(0.3, 0.9, 40)
    follows = np.vstack([np.ones(40), rng.integers(0, 2, 40)]).astype(float)
    got = model.subset_weights(follows, shares)
    assert np.allclose(got.sum(axis=1), follows.prod(axis=1) - shares.prod(), atol=1e-6)


def test_many_rows_and_trees_are_looked_up():
    """A hundred trees of depth 6 and 20,000 rows: 0.1 s for each thousand of them, where working
    out each leaf took 5 s. Deep paths have no tables and come out the same."""
    rng = np.random.default_rng(2)
    trees = [(0.1, t := grown(rng, 6, 30), model.leaf_paths(t)) for _ in range(100)]
    x = np.column_stack([rng.integers(0, 5, 20_000), rng.normal(size=(20_000, 29))]).astype(float)
    held, began = model.tabled(trees), time.process_time()
    got = model.looked_up(x, held)
    assert time.process_time() - began < 25
    leaves = [(w, t, base, *model.blocks(w, t, paths, most_bits=0)) for (w, t, paths), (_, _, base, _, _) in zip(trees, held, strict=True)]
    assert all(rest for *_, rest in leaves) and np.allclose(got[:50], model.looked_up(x[:50], leaves), atol=1e-9)
