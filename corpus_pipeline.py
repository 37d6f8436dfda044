"""A training corpus from raw documents: judge quality, drop toxic texts and near copies, mix sources, pack sequences.

Defined results: each stage works on all that the one before kept and returns the columns of its input, extra ones among them, but for the last. A null
text counts as empty in every stage; null ids, languages and sources are kept as they are. Repeated rows are rows of their own for
the classifiers and one group for ``near_duplicates``, which keeps one of them. An empty table, or one of which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import materialise
from spanloom.llm.mixing import mix
from spanloom.llm.ngram_join import keep_one
from spanloom.llm.packing import pack_documents
from spanloom.llm.quality import keep_good
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least 0.7; equal texts are kept or dropped together."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0. The classifier learns from the labelled ones among ``docs``."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more. Texts without words are near to nothing and stay."""
    return keep_one(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes n times is n rows."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: The stages learn models and pack greedily, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
