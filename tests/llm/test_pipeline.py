"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import re

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute, leaks

import corpus_pipeline
from listinglab.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{data}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        f(spark, docs, data).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "near duplicates", "decontamination", "mixing"]
    for _, before, after in stages[:-1]:
        assert sorted(after.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        assert dict(after.dtypes) == dict(before.dtypes)


def test_toxic_documents_go(spark, data, stages):
    _, before, after = stages[0]
    scores = toxicity.score_documents(before, spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores if not r["predicted"]}


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    rows = before.orderBy("doc_id").collect()
    _, comp = brute([r["text"] for r in rows])
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for i, r in enumerate(rows) if comp[i] == i}


def test_benchmark_passages_go(spark, data, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows, kept = before.orderBy("doc_id").collect(), {r["doc_id"]: r for r in after.collect()}
    for r, (n, hit, _) in zip(rows, leaks([r["text"] for r in rows], items, 10), strict=True):
        if hit > n / 2:
            assert r["doc_id"] not in kept
        elif hit:
            assert len(re.sub(r"\W", "", kept[r["doc_id"]]["text"])) < len(re.sub(r"\W", "", r["text"]))
        else:
            assert kept[r["doc_id"]] == r
    left = leaks([r["text"] for r in kept.values()], items, 10)
    assert not [x for x in left if x[1] == x[0] > 0]


def test_mix_comes_near_its_targets(stages):
    _, before, after = stages[3]
    assert before.count() == after.count()
    off = after.groupBy("source").agg((F.sum("taken") - F.max("target")).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert off <= 0.5


def test_run_gives_the_same(spark, data, stages):
    got = {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {(r["doc_id"], r["taken"]) for r in stages[3][2].collect()}


def test_stages_on_odd_rows_and_none(spark, data):
    words = "these five words and then some more of them stand here once again for all to read"
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, words, "en", None, None), (3, "x " * 60_000, "en", "b", 1), (3, "x " * 60_000, "en", "b", 1), (4, " \t ", "en", "b", 3), (5, words.upper(), "en", "a", 1), (6, words, "de", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for first in (docs, docs.limit(0)):
        now = first
        for name, f in corpus_pipeline.STAGES[:-1]:
            after = f(spark, now, data)
            assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
            now = spark.createDataFrame(after.collect(), docs.schema)
        mixed = corpus_pipeline.STAGES[-1][1](spark, now, data)
        assert mixed.count() == now.count()
        if first is docs:
            assert sorted((r["doc_id"] for r in now.collect()), key=str) == [1, 2, 3, 4, 5, None]
            assert {r["doc_id"]: r["size"] for r in mixed.collect()}[3] == 60_000


def test_stages_with_clashing_columns(spark, data):
    names = ["score", "y", "b", "key", "n", "class", "label", "items", "spans", "keep", "size", "taken", "target", "__k"]
    docs = spark.createDataFrame([(1, "one two three four five six", "s"), (2, "ONE two three four five six", "s")], "doc_id long, text string, source string").withColumns({c: F.lit(f"my {c}") for c in names})
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, data).collect(), docs.schema)
    (row,) = docs.collect()
    assert row["doc_id"] == 1 and all(row[c] == f"my {c}" for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).first()["label"] == "my label"
