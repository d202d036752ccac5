"""Scoring of pairs as they arrive.

A pair descriptor is one JSON row that names two packages whose files are already in the files table.
A pair is complete inside one micro-batch, so the batch plan runs unchanged and no state is kept.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from deltascope.plans.pairs import PairAnalysis

PAIR_SCHEMA = "pair_id string, extension_id string, old_package_id string, new_package_id string"


def arriving_pairs(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of pair descriptors from JSON files that appear in a folder."""
    return spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_arriving(
    pairs: DataFrame, load_files: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Score every arriving pair once and append the result below `output`.

    `load_files(packages)` gives the files of the packages of a batch. A batch writes its own folder and
    replaces it when it is retried, and pairs stored by an earlier batch are left out, so a repeated
    descriptor or a restart gives no second row.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["pair_id"])
        stored = stored_results(spark, output, before=batch_id)
        if stored is not None:
            fresh = fresh.join(stored.select("pair_id"), "pair_id", "left_anti")
        packages = fresh.select(F.explode(F.array("old_package_id", "new_package_id")).alias("package_id")).distinct()
        analysis = PairAnalysis(fresh, load_files(packages))
        result = analysis.scores.select("pair_id", "risk_score", "raw_score", "risk_class", "confidence", "recommendation")
        reasons = analysis.failed.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "side", "reason"))), "; ").alias("failed"))
        result = result.unionByName(reasons, allowMissingColumns=True)  # a pair that can't be compared has a reason and no score
        result.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        pairs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stored_results(spark: SparkSession, output: str, before: int | None = None) -> DataFrame | None:
    """Results of finished batches, or None when there are none."""
    try:
        stored = spark.read.option("basePath", output).parquet(f"{output}/batch=*")
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise
    return stored if before is None else stored.where(F.col("batch") < before)
