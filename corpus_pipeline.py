"""From raw documents to a sampled, tokenised mixture: five stages, each over all that the one before it kept.

Each stage is written as Parquet and read again as the next one's documents, so
a lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import exact, mixing, near, quality, sampling
from tillwise.llm.common import documents, stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy rejects go."""
    return quality.filter_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest original stays, then the smallest doc_id."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 on five-word shingles, the smallest doc_id stays."""
    return near.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned towards their target weights; documents drawn more than once appear so often."""
    return mixing.mix(docs).select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document into vocabulary ids."""
    return sampling.encode(docs)


STAGES = [
    ("quality rules", rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixture),
    ("sentencepiece", segmentation),
]

# The last stage samples by hashes that SQL does not have; tests compare the stages before it with SQL and the last one
# with an enumeration of all segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
