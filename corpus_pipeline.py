"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before has kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's input.  All but the last return the columns that documents has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import packing, quality_classifier, quality_rules, simhash
from cellweave.llm.runtime import materialise, read


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those it predicts as good, at its own threshold."""
    model = quality_classifier.learn(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.filter_documents(docs, model)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees.

    The trees are fitted on the labels of the raw documents: among those that the classifier has kept, hardly one is of low quality.
    """
    trees = quality_rules.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, trees)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8 or more."""
    return simhash.drop_similar(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a training sequence."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


STAGES = [("quality_classifier", classified), ("quality_rules", ruled), ("simhash", deduplicated), ("packing", packed)]

#: Learned verdicts decide which rows come through, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
