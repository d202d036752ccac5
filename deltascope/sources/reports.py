"""The curation reports of an intake result, one table each."""
from pyspark.sql import DataFrame, functions as F

from deltascope.operators import audits, curation

C = F.col


def curation_reports(curated: DataFrame) -> dict[str, DataFrame]:
    """Report name -> table, from curated records of all stages."""
    accepted = curated.where("stage = 'ACCEPTED'").withColumn("pair_id", C("record_id"))
    provenance = accepted.select(
        "record_id", F.concat_ws(":", "source_type", "record_id").alias("provenance_id"), "extension_id", "source_type",
        "source_reference", "old_sha256", "new_sha256", "label_source", "label_review_status", "label_quality_tier",
        "eligible_for_supervised_training", curation.report_provenance_complete(accepted).alias("complete"),
    )
    have = lambda name: C(name) if name in curated.columns else F.lit(None).cast("boolean").alias(name)
    return {
        "dataset": audits.intake_summary(curated),
        "provenance": provenance,
        "quality": curated.select(
            "record_id", "extension_id", "label", "label_source", "label_review_status", "label_quality_tier",
            "eligible_for_supervised_training", "stage", "quality_status", F.concat("reasons", "warnings").alias("reasons"),
        ),
        "duplicate": audits.duplicate_report(accepted),
        "leakage": audits.split_leakage(accepted),
        "license": curated.select(
            "record_id", "license", "license_status", have("redistribution_allowed"), have("research_use_allowed"),
            have("attribution_required"), "stage",
        ),
        "validation": curated.where((F.size("reasons") > 0) | (F.size("warnings") > 0)).select(
            "record_id", "stage", F.concat("reasons", "warnings").alias("reasons")
        ),
    }


def write_reports(reports: dict[str, DataFrame], output: str) -> dict[str, str]:
    paths = {}
    for name, table in reports.items():
        paths[name] = f"{output}/{name}_report.json"
        table.write.mode("overwrite").option("ignoreNullFields", "false").json(paths[name])
    return paths
