"""A corpus pipeline of four training-data operators.

`STAGES` lists its steps; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns
of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession

from listinglab.llm import decontaminate, jaccard_join, mixing, toxicity
from listinglab.llm.queries import table
from listinglab.sources.shared import dropped, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier of `labels` scores 0.3 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by shingle similarity of 0.75 or more."""
    return jaccard_join.keep_one(docs, percent=75)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words or more are cut out; documents that are more than half
    benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, cover=0.5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much a mix of the sources takes of each document."""
    return mixing.mix(docs, weights=[3, 1, 2], share=1.5, epochs=2.0)


STAGES = [("toxicity", toxicity_stage), ("near duplicates", near_duplicate_stage), ("decontamination", decontaminate_stage), ("mixing", mixing_stage)]

ORACLE_SQL = None  # a trained classifier decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            dropped(last)  # only the kept documents are read from here on
    return STAGES[-1][1](spark, docs, sf_dir)
