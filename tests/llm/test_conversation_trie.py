"""The conversation trie against brute force, over one block and over many."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from listinglab.llm import conversation_trie as ct

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, key string, depth int, block int"


def rebuilt(rows, family=20, most=4):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(convs):
    members = collections.defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ids) - 1) * len(SPACE.findall(p[-1][1])) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], ends(p)) for p, ids in members.items())


def found(spark, rows, blocks=None, fork=True):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], TURNS)
    seqs = ct.sequences(df)
    out = ct.trie(ct.forked(seqs) if fork else seqs, blocks)
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in out.collect())


@pytest.mark.parametrize("blocks", [None, 1, 3, 9])
def test_trie_equals_brute_force(spark, blocks):
    rnd = random.Random(blocks or 7)
    rows = [(c, t, rnd.choice("ua"), rnd.choice(["", "x", "x y", "x y z"])) for c in range(60) for t in range(rnd.choice([1, 2, 2, 5, 9]))]
    rows += [(c, t, "u", "same words here") for c in range(100, 140) for t in range(6)]  # copies
    rows += [(c, t, "u" if t < 6 else str(c % 3), "same words here") for c in range(140, 150) for t in range(8)]
    assert found(spark, rows, blocks) == brute(rebuilt(rows))


def test_odd_turns(spark):
    rows = [(None, 0, "u", "x"), (-21, 1, "u", "b"), (-21, None, "u", "a"), (-20, 0, None, None), (5, 0, "a", "z"), (5, 0, "a", "z"), (5, 0, "a", "y"), (5, 1, "a", "q " * 200_000), (3, 0, "u", "t"), (10**15, 0, "u", "t")]
    for blocks in (1, 4):
        assert found(spark, rows, blocks) == brute(rebuilt(rows))
    assert found(spark, []) == []


def test_long_conversation(spark):
    rows = [(c, t, "u", f"{t if t < 60 else t * c}") for c in (0, 20, 40) for t in range(90)]
    assert found(spark, rows, 3, fork=False) == brute(rebuilt(rows, most=1))


def test_range_minima():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 64, 65):
        v = rnd.integers(0, 4, n)
        table, at, least = ct.minima(v), rnd.integers(0, n + 1, 50), rnd.integers(0, 5, 50)
        right, left = ct.reach_right(table, at, least), ct.reach_left(table, at, least)
        for p, d, r, q in zip(at, least, right, left, strict=True):
            want = p
            while want < n and v[want] >= d:
                want += 1
            back = p
            while back > 0 and v[back - 1] >= d:
                back -= 1
            assert (want, back) == (r, q)
