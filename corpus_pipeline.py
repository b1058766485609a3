"""A training corpus from raw documents, in stages; each is written as Parquet and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on every row that its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import packing, quality, simhash, toxicity
from loomery.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject.

    Null and empty texts get the score of a text without n-grams; repeated rows are judged one by
    one; without labels, or with those of one class, the class's constant decides. An empty table stays
    empty; all columns stay, whatever their names.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects.

    Null and empty texts have no words and go; repeated rows stay or go together. An empty table
    stays empty; all columns stay, whatever their names.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id.

    Null and empty texts have one fingerprint and are one group, from which one row stays; repeated
    rows are near duplicates of each other; a null id stays only where no other row of its group
    has one. An empty table stays empty; all columns stay, whatever their names.
    """
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences, with digests of their ids.

    A null or empty text is one piece of its end token; repeated rows are packed each. An empty table
    gives no pieces; other columns are not carried.
    """
    return packing.digests(packing.packed(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: A trained classifier and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
