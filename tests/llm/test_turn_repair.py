"""Repair of conversations' turns against a plain search over all edits, in one chunk and in many."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from listinglab.llm import turn_repair

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SOLID = re.compile(r"[^\x20\x09-\x0D]")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    """Rows (conv_id, turn, role, text) as the contract damages them, by conversation."""
    out = collections.defaultdict(list)
    space = lambda v: " " if v is None else v
    for c, t, r, x in rows:
        k = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        r, x = space(r), space(x)
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out[c] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def brute(rows):
    """Forward over (rows read, state), cheapest first and then the least audit."""
    out = []
    for c, v in damaged(rows).items():
        seen, faults = set(), []
        for _, r, x in v:
            solid = SOLID.findall(x)
            faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((r, x))
        best = {(0, ""): (0, "", ())}

        def better(key, cost, audit, lines):
            if key not in best or (cost, audit) < best[key][:2]:
                best[key] = (cost, audit, lines)

        for i in range(len(v) + 1):
            for _ in range(3):  # inserted turns
                for q in ("", "s", "u", "a"):
                    if (i, q) in best:
                        cost, audit, lines = best[i, q]
                        new = "a" if q == "u" else "u"
                        better((i, new), cost + 5, audit + "I", (*lines, "assistant:" if new == "a" else "user:"))
            if i == len(v):
                break
            _, r, x = v[i]
            for q in ("", "s", "u", "a"):
                if (i, q) in best:
                    cost, audit, lines = best[i, q]
                    better((i + 1, q), cost + 2, audit + "D", lines)
                    if faults[i] not in ("blank", "duplicate"):
                        own = 5 if faults[i] == "truncated" else 0
                        if to := STEP.get((q, r[:1])):
                            better((i + 1, to), cost + own, audit + "K", (*lines, f"{r}:{x}"))
                        new = "a" if q == "u" else "u"
                        better((i + 1, new), cost + own + 1, audit + "R", (*lines, f"{'assistant' if new == 'a' else 'user'}:{x}"))
        cost, audit, lines = min(best[len(v), q] for q in ("", "a") if (len(v), q) in best)
        turns = [t for t, _, _ in v if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        who = [r[:1] for _, r, _ in v]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:], strict=False))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, n long")
    out = turn_repair.digests(turn_repair.repair(turn_repair.damage(df), n="n", **how))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)


def conversations(seed):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["Yes.", "No!", "why", "so? ", " \n", "", "Well.\t", None, "a.b", "é"]) if rnd.random() < 0.5 else f"t{rnd.random()}" + rnd.choice(".!? ")
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant", "u"])
    return [(c, t, role(), text()) for c in range(60) for t in sorted(rnd.sample(range(40), rnd.randint(1, 14)))] + [(900, t, role(), text()) for t in range(60)] + [(901, t, "user", f"cut {t}") for t in range(40)] + [(901, 41, "system", "s."), (901, 42, "user", "q?"), (901, 43, "assistant", "a.")]


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 3, "blocks": 5}, {"chunk_rows": 1, "blocks": 2}])
def test_repair_equals_search(spark, how):
    rows = conversations(len(how))
    assert found(spark, rows, **how) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "x."), (1, None, "user", "x."), (1, 2, "assistant", "y " * 300_000 + "."), (1, 2, "assistant", "y " * 300_000 + "."), (2, 5, "system", "Only."), (3, -4, "user", "\x0b"), (4, 0, "user", "a" * 70 + "c."), (4, 0, "user", "a" * 70 + "b.")]
    rows += [(5, t, "user", "Same text.") for t in range(50)]
    for how in ({}, {"chunk_rows": 2, "chunk_bytes": 10, "blocks": 3}):
        assert found(spark, rows[:-52], **how) == brute(rows[:-52])
        assert found(spark, rows[8:], **how)[1:] == brute(rows[8:])[1:]  # the first ties beyond 64 characters
    assert found(spark, []) == []
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and found(spark, gone) == brute(gone) and {r[1:8] for r in brute(gone)} == {(0, 0, 0, 0, 0, 0, "")}


def test_pieces_hold_the_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "no end"), (1, 2, "tool", "Done."), (1, 3, "user", "More?")], "conv_id long, turn long, role string, text string")
    (piece,) = turn_repair.repair(df).collect()
    assert [(t["role"], t["text"]) for t in piece["turns"]] == [("user", "Hi."), ("assistant", "More?")] and piece["audit"] == "KDDR" and piece["cost"] == 5


def test_vectors_meet_soon():
    rnd = random.Random(4)
    codes = bytes(4 * rnd.randrange(4) + rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(5000))
    a, b = turn_repair.worked_back(codes, turn_repair.END), turn_repair.worked_back(codes, bytes(4))
    assert a[: 4 * 4900] == b[: 4 * 4900]
    assert turn_repair.worked_back(codes, bytes(4), a) == b
