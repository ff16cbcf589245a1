"""Upserts into a bucketed table: the same rows as a plain merge, and the target stays where it is."""

import random

import pytest

from listinglab.operators import merge

SCHEMA = "source string, k long, price double, id long, seen int"
ARGS = (["source", "k"], ["price"], ["id"], ["seen"])


def rows_of(rnd, n, price):
    keys = {(rnd.choice(["a", "b", "", None]), rnd.choice([None, *range(n)])) for _ in range(n)}
    return [(s, k, rnd.choice([None, price, 1.0]), i, rnd.randrange(9)) for i, (s, k) in enumerate(sorted(keys, key=repr))]


def plain(df):
    return sorted(map(tuple, df.select("source", "k", "price", "id", "seen", "action").collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def names(spark):
    names = ["merged_0", "merged_1"]
    yield names
    for n in names:
        spark.sql(f"drop table if exists {n}")


def test_equals_a_plain_merge_and_moves_the_source_only(spark, names):
    rnd = random.Random(3)
    old, new, third = (spark.createDataFrame(rows_of(rnd, 200, p), SCHEMA) for p in (2.0, 3.0, 4.0))
    target = merge.save_bucketed(old, names[0], ARGS[0], 8)
    want, got = merge.merge_upsert(old, new, *ARGS), merge.merge_upsert(target, new, *ARGS)
    assert plain(got) == plain(want) and {r[-1] for r in plain(got)} == {"inserted", "updated", "unchanged", "kept"}
    assert exchanges(want) == 2 and exchanges(got) == 1
    # The snapshot goes into the next table as it lies, and that one is merged into just so.
    after = merge.save_bucketed(got.drop("action"), names[1], ARGS[0], 8, dealt=True)
    assert len(after.inputFiles()) <= 8
    got = merge.merge_upsert(after, third, *ARGS)
    assert plain(got) == plain(merge.merge_upsert(want.drop("action"), third, *ARGS))
    assert exchanges(got) == 1


def test_empty_sides(spark, names):
    rows = spark.createDataFrame([(None, None, 1.0, 1, 1), ("a", 1, None, 2, 2)], SCHEMA)
    none = rows.limit(0)
    target = merge.save_bucketed(rows, names[0], ARGS[0], 4)
    assert [r[-1] for r in plain(merge.merge_upsert(target, none, *ARGS))] == ["kept"] * 2
    target = merge.save_bucketed(none, names[1], ARGS[0], 4)
    assert [r[-1] for r in plain(merge.merge_upsert(target, rows, *ARGS))] == ["inserted"] * 2
