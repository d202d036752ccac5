"""Stored analyses: append, look up, list the latest."""
from pyspark.sql import DataFrame, SparkSession, functions as F


def append_results(scored: DataFrame, path: str, created_at: str | None = None) -> None:
    """Append scored pairs with their creation time, partitioned by day."""
    created = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    rows = scored.withColumn("created_at", created).withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def result_of(spark: SparkSession, path: str, pair_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("pair_id") == pair_id)


def latest_results(spark: SparkSession, path: str, count: int = 10) -> DataFrame:
    """The newest analyses; a top-k, so only `count` rows per task are kept while sorting."""
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "pair_id").limit(count)
