"""Stored feature tables: reading, writing, and growing them."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltascope import vocab
from deltascope.operators import audits, features as feature_ops, splits

SCHEMA_VERSION = "1.0"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """CSV feature table with typed columns: blanks in numbers become 0.0, flags become booleans."""
    names = spark.read.option("header", "true").csv(path).columns
    raw = spark.read.schema(", ".join(f"`{name}` string" for name in names)).option("header", "true").csv(path)
    typed = []
    for name in names:
        if name in ("eligible_for_supervised_training", "is_controlled"):
            typed.append((F.lower(F.col(name)) == "true").alias(name))
        elif name in vocab.METADATA_COLUMNS:
            typed.append(F.col(name))
        else:
            typed.append(F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name))
    return raw.select(*typed)


def dataset_summary(features: DataFrame) -> DataFrame:
    """Counts per label, split and missing analyser: {dimension, value, records}."""
    counted = audits.distributions(features, ["label", "split"]).select("dimension", "value", "records")
    missing = audits.analyzer_missingness(features).where("analyzer_flag <> 'total' and missing > 0")
    return counted.unionByName(missing.select(F.lit("missingness").alias("dimension"), F.col("analyzer_flag").alias("value"), F.col("missing").alias("records")))


def feature_schema(spark: SparkSession) -> DataFrame:
    rows = [(SCHEMA_VERSION, name, family, kind, projections) for name, family, kind, projections in vocab.FEATURES]
    return spark.createDataFrame(rows, "schema_version string, name string, family string, representation string, projections array<string>")


def write_feature_artifacts(features: DataFrame, output: str, failed: DataFrame | None = None, *, dataset_id: str, dataset_version: str) -> list[str]:
    """Write every projection as CSV and JSON lines, the schema, a summary and a manifest; refuse failed extractions."""
    if failed is not None and not failed.isEmpty():
        raise ValueError("cannot write artifacts for invalid or failed extraction result")
    leaks = audits.feature_name_leaks([name for name in features.columns if name not in vocab.METADATA_COLUMNS])
    if leaks:
        raise ValueError(f"feature name may leak target or path information: {leaks[0][0]}")
    spark = features.sparkSession
    paths = []

    def store(frame: DataFrame, name: str, form: str):
        path = f"{output}/{name}"
        writer = frame.write.mode("overwrite")
        writer.option("header", "true").csv(path) if form == "csv" else writer.option("ignoreNullFields", "false").json(path)
        paths.append(path)

    for name in vocab.PROJECTIONS:
        table = feature_ops.projection(features, name)
        store(table, f"{name}.csv", "csv")
        store(table, f"{name}.jsonl", "json")
    store(feature_schema(spark), "feature_schema.json", "json")
    store(dataset_summary(features), "dataset_summary.json", "json")
    manifest = features.agg(F.count("*").alias("record_count")).withColumns(
        {
            "feature_schema_version": F.lit(SCHEMA_VERSION),
            "projections": F.array(*[F.lit(name) for name in vocab.PROJECTIONS]),
            "source_dataset_identifier": F.lit(dataset_id),
            "source_dataset_version": F.lit(dataset_version),
        }
    )
    store(manifest, "extraction_manifest.json", "json")
    return paths


def reusable(manifest: DataFrame, dataset_version: str, expected_records: int) -> bool:
    """Whether stored features belong to this dataset version and have the expected size."""
    row = manifest.select("source_dataset_version", "record_count").first()
    return bool(row) and row["source_dataset_version"] == dataset_version and row["record_count"] == expected_records


def extend_features(stored: DataFrame, pairs: DataFrame, compute: Callable[[DataFrame], DataFrame], assignments: DataFrame | None = None) -> DataFrame:
    """Stored rows plus rows computed for the pairs that are not stored yet; splits are re-assigned when given."""
    fresh = pairs.join(stored.select(F.col("record_id").alias("pair_id")), "pair_id", "left_anti")
    merged = stored.unionByName(compute(fresh), allowMissingColumns=True)
    if assignments is None:
        return merged
    columns = merged.columns
    return splits.apply_split(merged, assignments, required=True).select(*columns)
