"""Registered queries of this subpackage: each operator over its whole table with production parameters."""
from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltascope.llm import bitpack, bpe, byte_cnn, collocations, common, conversations, grid_join, language_id, licence_scan, maxent_lm, minhash, oracles, packing, quality_rules, recompression
from deltascope.llm.paths import RANKS, TOKENIZER, TOKENIZER_SIZE


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.fold_of(F.col("doc_id"), 5) == 1)
    return maxent_lm.learn_and_score(docs)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.fold_of(F.col("doc_id"), 4) == 2)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.with_language(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), TOKENIZER)


def op4_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.similar_vectors(common.table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.fold_of(F.col("doc_id"), 5) == 0)
    net = byte_cnn.fit(docs.where("not held_out"), common.table(spark, sf_dir, "labels"))
    scored = byte_cnn.with_score(docs.select("doc_id", "held_out", "text"), net).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= byte_cnn.THRESHOLD).cast("int"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(common.table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.stored(quality_rules.document_stats(common.table(spark, sf_dir, "documents")), "stats")
    cutoffs = quality_rules.learn(stats, common.table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, cutoffs)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitpack.write(common.table(spark, sf_dir, "documents"), common.shared_folder(spark, "ids"), TOKENIZER, TOKENIZER_SIZE)
    return bitpack.read(files)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), RANKS)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(common.table(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_grid_join": op4_grid_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_licence_scan": op6_licence_scan,
    "op7_minhash": op7_minhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_files": op9_token_files,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_recompression": op13_recompression,
    "pipeline": corpus_pipeline.run,
}
#: Cosines of all pairs of one label, and the smallest id that each vector reaches.
OP4_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS low FROM embeddings
  UNION
  SELECT l.a, r.low FROM reach r JOIN links l ON l.b = r.node WHERE r.low < l.a
), lowest AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN lowest ON node = e.vec_id LEFT JOIN counted ON a = e.vec_id
"""

ORACLES: dict[str, str] = {
    "op4_grid_join": OP4_SQL,
    "op6_licence_scan": licence_scan.scan_sql(),
    "op11_conversation_repair": oracles.OP11_SQL,
    "op12_collocations": oracles.OP12_SQL,
    "op13_recompression": oracles.OP13_SQL,
}
