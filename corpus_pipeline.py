"""A corpus pipeline of five stages, each over all that its predecessor kept.

Toxic documents go; one document of each group of near duplicates stays; secrets are masked; sources are mixed to
their target weights by whole copies; what is left is packed into windows. All stages but the last return the columns of
documents, whatever else a table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.llm import mixing, near_duplicates, packing, secrets, toxicity
from pixelspark.llm.common import discard, written

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score TOXIC_FROM or more. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(spark, docs, labels)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return toxicity.score_documents(docs, model, name).where(F.col(name) < TOXIC_FROM).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row of the least doc_id (null last; of equal ids the least row hash), once.

    Documents without words stay, and so does each of several texts under one doc_id that is a copy of nothing."""
    return near_duplicates.one_of_each_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Packing by tokenizers, random mixing and a trained model are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            discard(before)
    return docs
