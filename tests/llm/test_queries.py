"""The operators' queries against their DuckDB twins, and the others against brute force."""

import zlib

import pytest
from oracle import connect, same

from listinglab.llm import queries


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, con, name):
    same(queries.QUERIES[name](spark, data), con, queries.ORACLE_SQL[name])


def test_toxicity_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(labels[r["doc_id"]] == r["predicted"] for r in held) / len(held) > 0.9


def test_token_count_query(spark, data):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op4_token_counts(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        n = len(sp.encode(r["text"] or ""))
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 4096)


def test_url_query(spark, data):
    got = queries.op10_url_rules(spark, data).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        host, _, path = urls[r["page_id"]].split("://", 1)[1].partition("/")
        path = ("/" + path).split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        if fit:
            assert r["verdict"] == max(fit)[2]
