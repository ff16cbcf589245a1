"""The operators' queries over the driver's tables, and DuckDB SQL for those SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_trie, decontaminate, jaccard_join, lm_score, merkle_audit, mixing, template_extract, token_counts, topk_search, toxicity, turn_repair, url_rules
from .oracles import ORACLE_SQL as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.expand_prefix_targets(turns))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return topk_search.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, weights=[3, 1, 2], share=1.5, epochs=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), percent=75)


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of the pages' WARC records. The second is derived from the same
    table: records of page_id mod 1009 = 17 have one byte overwritten, those of page_id mod
    1511 = 5 are lost; offsets are those of the index made when the files were written."""
    records = merkle_audit.warc_records(table(spark, sf_dir, "pages"))
    broken = F.when(F.col("page_id") % 1009 == 17, F.concat(F.lit("X"), F.substr("record", F.lit(2)))).otherwise(F.col("record"))
    index = merkle_audit.indexed(records, {"later": broken})
    later = index.where("page_id is null or page_id % 1511 <> 5").select("file", "offset", F.col("later").alias("digest"))
    return merkle_audit.audit(index.select("file", "offset", "digest"), later, hashed=True)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _scored(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"), alpha=0.4, least=2, order=order)
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log": F.round("mean_log", 4)})


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 3)


def op9_lm_score_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 2)


def op9_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 3)


# The rules (host, path, verdict) that op10 judges by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as t(host, path, verdict)")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, labels)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turn_repair.damage(table(spark, sf_dir, "conversations"))
    return turn_repair.digests(turn_repair.repair(damaged, n="n"))


def op12_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extract.extract(table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = conversation_trie.sequences(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.forked(seqs, family=20, most=4))


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_topk_search": op2_topk_search,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_merkle_audit": op7_merkle_audit,
    "op8_decontaminate": op8_decontaminate,
    "op9_lm_score": op9_lm_score,
    "op9_lm_score_order2": op9_lm_score_order2,
    "op9_lm_score_order3": op9_lm_score_order3,
    "op10_url_rules": op10_url_rules,
    "op11_turn_repair": op11_turn_repair,
    "op12_template_extract": op12_template_extract,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL = ORACLES
