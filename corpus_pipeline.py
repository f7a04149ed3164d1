"""A training-data pipeline over ``documents``.

Each stage takes the rows its predecessor kept, written as Parquet and read again, and
works on all of them.  The first three return the columns of documents; the last packs
what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import near_dup, packing, quality_rules, weak_labels
from foliospark.llm.common import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject.

    Rows keep all their columns; rows without id stay, repeated rows go or stay together, a null text is judged
    as an empty one, and no rows give no rows."""
    return weak_labels.keep_documents(docs, Scratch(spark, "classifier"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host passes.

    Rows keep all their columns; rows without id stay, a document without host is judged by the base rule alone,
    and no rows give no rows."""
    return quality_rules.keep_documents(docs, Scratch(spark, "rules"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Rows keep all their columns; rows without id stay, texts without words are no duplicates, and no rows give no rows."""
    return near_dup.drop_duplicates(docs, Scratch(spark, "dedup"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences along the Hilbert curve.

    A null text is its end id alone, repeated rows are packed each time, and no rows give no pieces."""
    return packing.pack(docs, Scratch(spark, "packing"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("minhash_near_dedup", near_dedup),
    ("packing", pack),
]

#: The stages learn, hash and tokenize; SQL cannot express them.  Tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
