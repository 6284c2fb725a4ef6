"""The corpus pipeline: five stages, each an operator of granary.llm, over all that its predecessor kept.

Null and empty texts, null ids, repeated rows, empty tables and further columns (whatever their
names) go through every stage as its operator's docstring says; without trusted positives among
the labels the classifier rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, nearcopies, packing, quality, secrets
from granary.llm.common import keep, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; those that the classifier rejects go."""
    return quality.without_rejected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs with a Jaccard similarity of five-word shingles of 0.8 or more link.

    SimHash links come first, each checked on the shingles; MinHash cells propose what they can't hold together.
    """
    return nearcopies.without_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; words are ranked over these documents."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", classify), ("near_dedup", dedup), ("decontamination", decontaminated), ("secrets", redact), ("packing", pack)]
#: No SQL: classification, fingerprints and token ids have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, each written and read again: the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
