"""Manifest projections and the import manifest."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

IMPORT_SCHEMA = """dataset_version string, records array<struct<
  record_id string, extension_id string, extension_name string, source_type string, source_reference string,
  source_repository string, source_url string, source_dataset string, acquisition_timestamp string, collector string,
  license string, license_status string, redistribution_allowed boolean, research_use_allowed boolean,
  attribution_required boolean, is_controlled boolean, controlled_mutation_type string, label string,
  label_source string, label_confidence string, label_review_status string, label_quality_tier string,
  label_rationale string, eligible_for_supervised_training boolean, functional_category string,
  review_packet_path string, evidence_references array<string>, split string,
  old struct<path string, version string, timestamp string, timestamp_source string, timestamp_confidence string,
    extension_id string, sha256 string, raw_sha256 string, normalized_sha256 string, tag string, download_url string>,
  new struct<path string, version string, timestamp string, timestamp_source string, timestamp_confidence string,
    extension_id string, sha256 string, raw_sha256 string, normalized_sha256 string, tag string, download_url string>,
  notes array<string>>>"""


def read_import_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an import manifest, with its dataset version."""
    loaded = spark.read.schema(_one_line(IMPORT_SCHEMA)).option("multiLine", "true").json(path)
    return loaded.select("dataset_version", F.inline("records"))


def _one_line(schema: str) -> str:
    import re

    flat = " ".join(schema.split())
    # Fields inside a struct are written name: type.
    head, body = flat.split("array<struct<", 1)
    body = re.sub(r"(\w+) (string|boolean|array<string>|struct<)", r"\1: \2", body)
    return head + "array<struct<" + body


def project_manifests(manifests: DataFrame) -> DataFrame:
    """Fixed columns out of free manifests {package_id, manifest (JSON text)}.

    Lists keep their order and repeats. Items of `permissions` that look like a host pattern are hosts;
    `host_permissions` counts from manifest version 3 and skips hosts that are already listed.
    """
    parsed = manifests.select("package_id", F.try_parse_json("manifest").alias("m"))
    pick = lambda path, kind: F.try_variant_get(F.col("m"), path, kind)
    empty = F.array().cast("array<string>")
    strings = lambda path: F.coalesce(
        F.transform(
            F.filter(pick(path, "array<variant>"), lambda item: F.schema_of_variant(item) == "STRING"),
            lambda item: F.try_variant_get(item, "$", "string"),
        ),
        empty,
    )
    base = parsed.select(
        "package_id",
        "m",
        F.col("m").isNotNull().alias("manifest_is_valid"),
        F.coalesce(pick("$.manifest_version", "int"), F.lit(2)).alias("manifest_version"),
        strings("$.permissions").alias("_listed"),
        strings("$.host_permissions").alias("_host_listed"),
        strings("$.optional_permissions").alias("_optional"),
    )
    looks_like_host = lambda item: item.contains("://") | (item == "<all_urls>")
    listed_hosts = F.filter("_listed", looks_like_host)
    extra = F.array_distinct(F.filter("_host_listed", lambda item: ~F.array_contains(listed_hosts, item)))
    json = lambda path: F.to_json(F.try_variant_get(F.col("m"), path, "variant"))
    resources = F.coalesce(pick("$.web_accessible_resources", "array<variant>"), F.array().cast("array<variant>"))
    counted = F.aggregate(
        F.transform(
            resources,
            lambda item: F.when(
                F.schema_of_variant(item).startswith("OBJECT"),
                F.coalesce(F.size(F.try_variant_get(item, "$.resources", "array<variant>")), F.lit(0)),
            ).otherwise(F.lit(1)),
        ),
        F.lit(0),
        lambda total, size: total + F.greatest(size, F.lit(0)),
    )
    return base.select(
        "package_id",
        "manifest_is_valid",
        F.coalesce(pick("$.name", "string"), F.lit("Unknown Extension")).alias("name"),
        F.coalesce(pick("$.version", "string"), F.lit("1.0")).alias("version"),
        "manifest_version",
        F.filter("_listed", lambda item: ~looks_like_host(item)).alias("permissions"),
        F.when(F.col("manifest_version") >= 3, F.concat(listed_hosts, extra)).otherwise(listed_hosts).alias("hosts"),
        F.array_distinct("_optional").alias("optional_permissions"),
        F.coalesce(json("$.background"), F.lit("{}")).alias("background"),
        F.coalesce(json("$.content_scripts"), F.lit("[]")).alias("content_scripts"),
        F.coalesce(json("$.content_security_policy"), F.lit('""')).alias("content_security_policy"),
        json("$.externally_connectable").alias("externally_connectable"),
        counted.alias("web_accessible_resource_count"),
    )


def manifests_of(files: DataFrame) -> DataFrame:
    """The root manifest of every package as {package_id, manifest}."""
    return files.where(F.col("path") == "manifest.json").select("package_id", F.col("content").alias("manifest"))


def is_empty_json(text: Column) -> Column:
    """Absent, or empty in any JSON sense."""
    return text.isNull() | text.isin("{}", '""', "[]", "null", "false", "0", "0.0")
