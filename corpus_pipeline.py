"""From raw documents to packed training sequences, in stages that each read what the one before has written."""
from pyspark.sql import DataFrame, SparkSession

from deltascope.llm import byte_cnn, common, minhash, packing, quality_rules
from deltascope.llm.paths import TOKENIZER


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; cutoffs come from the labelled ones among them."""
    return quality_rules.keep(docs, common.table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, trained on the labelled ones among them, does not call bad."""
    return byte_cnn.keep(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.keep(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of the training length."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("minhash_dedup", near_duplicates), ("packing", sequences)]

#: No stage but the first could be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
