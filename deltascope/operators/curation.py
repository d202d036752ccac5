"""Curation of the pair table: intake, tiers, eligibility, validation, provisional labels."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from deltascope import vocab
from deltascope.functions.numbers import lookup, present, reasons
from deltascope.functions.versions import compare_versions, iso_time

C = F.col


def _quoted(text: str, value: Column, rest: str) -> Column:
    return F.concat(F.lit(f"{text} '"), F.coalesce(value, F.lit("")), F.lit(f"'{rest}"))


def _have(frame: DataFrame, name: str, kind: str = "string") -> Column:
    return C(name) if name in frame.columns else F.lit(None).cast(kind)


def label_ontology(spark: SparkSession) -> DataFrame:
    rows = [(name, order, allowed) for name, (order, allowed) in vocab.LABELS.items()]
    return spark.createDataFrame(rows, "label string, severity_order int, allowed_for_training boolean")


def label_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.LABEL_SOURCES.items()), "label_source string, reliability_order int")


def allowed_for_training(label: Column) -> Column:
    return lookup(label, {name: allowed for name, (_, allowed) in vocab.LABELS.items()}, False)


def quality_tier(label: Column, source: Column, status: Column, explicit: Column) -> Column:
    """Tier of a label; an explicit tier wins, an unknown explicit one counts as uncertain."""
    return (
        F.when(present(explicit), F.when(explicit.isin(vocab.QUALITY_TIERS), explicit).otherwise("UNCERTAIN"))
        .when(label.isin("uncertain", "needs_review", "excluded"), "UNCERTAIN")
        .when(source == "controlled_ground_truth", "CONTROLLED_GROUND_TRUTH")
        .when(source.isin("peer_reviewed_dataset_label", "reputable_security_report"), "EXTERNAL_CONFIRMED")
        .when((source == "multi_analyst_manual_review") | (status == "adjudicated"), "MULTI_REVIEWER_ADJUDICATED")
        .otherwise("SINGLE_REVIEWER_PROVISIONAL")
    )


def training_eligible(label: Column, tier: Column, complete: Column, stage: Column, explicit: Column) -> Column:
    allowed = (
        (stage == "ACCEPTED") & complete & label.isin(vocab.SUPERVISED_LABELS) & (tier != "UNCERTAIN")
    )
    return F.coalesce(allowed, F.lit(False)) & F.coalesce(explicit, F.lit(True))


def attach_packages(records: DataFrame, packages: DataFrame) -> DataFrame:
    """Facts of both archives of a record, from {path, sha256, manifest_name, problem}.

    A path that is not in the table does not exist.
    """
    joined = records
    for side in ("old", "new"):
        facts = packages.select(
            C("path").alias(f"{side}_path"),
            C("sha256").alias(f"{side}_sha256"),
            C("manifest_name").alias(f"{side}_manifest_name"),
            F.coalesce("problem", F.lit("")).alias("_problem"),
        )
        joined = joined.join(facts, f"{side}_path", "left").withColumn(
            f"{side}_problem",
            F.when(~F.coalesce(present(C(f"{side}_path")), F.lit(False)), f"missing {side} package path")
            .when(C("_problem").isNull(), f"{side} package path does not exist")
            .when(C("_problem") != "", F.concat(F.lit(f"{side} "), C("_problem"))),
        ).drop("_problem")
    return joined


def flatten_import(records: DataFrame) -> DataFrame:
    """Import-manifest records with the old and new structs as prefixed columns."""
    nested = lambda side: [
        C(f"{side}.path").alias(f"{side}_path"), C(f"{side}.version").alias(f"{side}_version"),
        C(f"{side}.timestamp").alias(f"{side}_timestamp"), C(f"{side}.extension_id").alias(f"{side}_extension_id"),
        C(f"{side}.sha256").alias(f"{side}_expected_sha256"), C(f"{side}.raw_sha256").alias(f"{side}_raw_sha256"),
    ]
    plain = [name for name in records.columns if name not in ("old", "new")]
    return records.select(*plain, *nested("old"), *nested("new"))


def provenance_complete(frame: DataFrame) -> Column:
    """The intake rule: identity, versions, both hashes, source, license status, label source."""
    needed = [
        "record_id", "extension_id", "extension_name", "old_version", "new_version", "old_sha256", "new_sha256",
        "source_reference", "license_status", "label_source",
    ]
    return _all_present(frame, needed)


def report_provenance_complete(frame: DataFrame) -> Column:
    """The stricter rule of the reports: also times, raw hashes, review status and tier."""
    needed = [
        "record_id", "extension_id", "extension_name", "source_type", "source_reference", "acquisition_timestamp",
        "old_sha256", "new_sha256", "old_raw_sha256", "new_raw_sha256", "license_status", "label_source",
        "label_review_status", "label_quality_tier", "old_timestamp", "new_timestamp",
    ]
    return _all_present(frame, needed)


def _all_present(frame: DataFrame, names: list[str]) -> Column:
    result = F.lit(True)
    for name in names:
        result = result & F.coalesce(present(_have(frame, name)), F.lit(False))
    return result


def intake(records: DataFrame) -> DataFrame:
    """Judge every record: reasons, warnings, stage, quality, tier, eligibility.

    Works on flattened import records with package facts attached; a column that is missing counts as null.
    """
    have = lambda name, kind="string": _have(records, name, kind)
    source_type = F.coalesce(have("source_type"), F.lit("unknown/unverified"))
    license_status = F.coalesce(have("license_status"), F.lit("unknown"))
    label_source = F.coalesce(have("label_source"), F.lit("unknown"))
    review_status = F.coalesce(have("label_review_status"), F.lit("unreviewed"))
    label = F.coalesce(have("label"), F.lit(""))
    explicit_tier = have("label_quality_tier")
    blank = lambda name: ~F.coalesce(present(have(name)), F.lit(False))
    order = compare_versions(have("old_version"), have("new_version"), have("old_timestamp"), have("new_timestamp"))
    bad_time = lambda name: ~blank(name) & iso_time(have(name)).isNull()
    differs = lambda side: F.lower(have(f"{side}_expected_sha256")) != F.lower(have(f"{side}_sha256"))
    names_differ = present(have("old_manifest_name")) & present(have("new_manifest_name")) & (have("old_manifest_name") != have("new_manifest_name"))
    ids_differ = present(have("old_extension_id")) & present(have("new_extension_id")) & (have("old_extension_id") != have("new_extension_id"))
    why = reasons(
        *[(blank(name), f"missing {name}") for name in ("record_id", "extension_id", "extension_name", "source_reference", "label_rationale")],
        (~source_type.isin(vocab.ACCEPTABLE_SOURCES), _quoted("source_type", source_type, " is not acceptable for automatic research intake")),
        (~license_status.isin(vocab.RESEARCH_LICENSES), _quoted("license_status", license_status, " blocks automatic acceptance")),
        (~label.isin(list(vocab.LABELS)), _quoted("invalid label", label, "")),
        (~label_source.isin(list(vocab.LABEL_SOURCES)), _quoted("invalid label_source", label_source, "")),
        (~review_status.isin(vocab.REVIEW_STATUSES), _quoted("invalid label_review_status", review_status, "")),
        (present(explicit_tier) & ~explicit_tier.isin(vocab.QUALITY_TIERS), _quoted("invalid label_quality_tier", explicit_tier, "")),
        (label_source == "unknown", "label_source is unknown"),
        (label_source == vocab.OWN_SCORE_SOURCE, "label_source must not be the engine's own score"),
        (label == "excluded", "label is excluded"),
        (have("old_problem").isNotNull(), have("old_problem")),
        (have("new_problem").isNotNull(), have("new_problem")),
        (differs("old"), "old package SHA-256 mismatch"),
        (differs("new"), "new package SHA-256 mismatch"),
        (ids_differ, "old/new extension IDs do not match"),
        (order.isNull(), "version order cannot be established"),
        (order <= 0, "old/new version order is not longitudinal"),
        (bad_time("old_timestamp"), "old timestamp is invalid"),
        (bad_time("new_timestamp"), "new timestamp is invalid"),
        (bad_time("acquisition_timestamp"), "acquisition timestamp is invalid"),
    )
    warn = reasons(
        (label.isin("uncertain", "needs_review"), _quoted("label", label, " is retained for review/exclusion and not automatically accepted")),
        (names_differ, "manifest names differ; identity accepted only with external evidence"),
    )
    filled = records.withColumns(
        {
            "source_type": source_type, "license_status": license_status, "label_source": label_source,
            "label_review_status": review_status, "label": label,
            "label_quality_tier": quality_tier(label, label_source, review_status, explicit_tier),
            "is_controlled": F.coalesce(have("is_controlled", "boolean"), source_type == "controlled"),
            "reasons": why, "warnings": warn,
        }
    )
    quarantined = C("license_status").isin(vocab.QUARANTINE_LICENSES) | (C("source_type") == "unknown/unverified")
    has_reasons, has_warnings = F.size("reasons") > 0, F.size("warnings") > 0
    staged = filled.withColumn("provenance_complete", provenance_complete(filled)).withColumn(
        "stage", F.when(has_reasons & quarantined, "QUARANTINED").when(has_reasons, "EXCLUDED").otherwise("ACCEPTED")
    )
    return staged.withColumns(
        {
            "quality_status": F.when(has_reasons & quarantined, "QUESTIONABLE")
            .when(has_reasons, "REJECTED")
            .when(has_warnings, "QUESTIONABLE")
            .when(C("provenance_complete"), "COMPLETE")
            .otherwise("PARTIAL"),
            "eligible_for_supervised_training": training_eligible(
                C("label"), C("label_quality_tier"), C("provenance_complete"), C("stage"),
                have("eligible_for_supervised_training", "boolean"),
            ),
        }
    )


def validate(records: DataFrame) -> DataFrame:
    """Errors and warnings per record, as {pair_id, errors, warnings}; split leakage and repeated ids included.

    Group facts are pre-aggregated by key and joined back, so a frequent key is one small row on that side.
    """
    have = lambda name: _have(records, name)
    blank = lambda name: ~F.coalesce(present(have(name)), F.lit(False))
    required = [
        "pair_id", "extension_id", "extension_name", "old_version", "new_version", "old_archive_path", "new_archive_path",
        "source", "license", "label", "label_rationale",
    ]
    known = have("label").isin(list(vocab.LABELS))
    old_time, new_time = iso_time(have("old_timestamp")), iso_time(have("new_timestamp"))
    bad = lambda name: ~blank(name) & iso_time(have(name)).isNull()
    # Only keys at fault are joined back; frequent ones are left to adaptive execution, which splits their rows.
    counts = records.groupBy("pair_id").agg(F.count("*").alias("_copies")).where("_copies > 1")
    experiment = C("split").isNotNull() & (C("split") != vocab.HOLDOUT_SPLIT)
    groups = records.groupBy("extension_id").agg(
        (F.min(F.when(experiment, C("split"))) != F.max(F.when(experiment, C("split")))).alias("_leaks")
    ).where("_leaks")
    joined = records.join(counts, "pair_id", "left").join(groups, "extension_id", "left")
    confidence = F.coalesce(have("label_confidence"), F.lit("high"))
    missing_hash = lambda side: F.lower(have(f"{side}_actual_sha256")) != F.lower(have(f"{side}_sha256"))
    errors = reasons(
        *[(blank(name), f"missing {name}") for name in required],
        *[(blank(name), f"missing provenance.{name}") for name in ("source_type", "source_uri", "collection_timestamp")],
        (~F.coalesce(known, F.lit(False)), _quoted("invalid label", have("label"), "")),
        (known & ~confidence.isin(vocab.CONFIDENCES), _quoted("invalid label_confidence", confidence, "")),
        ((have("label") == "controlled_malicious_transition") & blank("controlled_mutation_type"), "controlled malicious label requires controlled_mutation_type"),
        (bad("old_timestamp") | bad("new_timestamp") | bad("collection_timestamp"), "invalid timestamp"),
        (old_time > new_time, "old_timestamp is after new_timestamp"),
        (C("split").isNotNull() & ~C("split").isin(*vocab.SPLITS, vocab.HOLDOUT_SPLIT), _quoted("invalid split", C("split"), "")),
        (C("_copies") > 1, "duplicate pair_id"),
        (missing_hash("old"), "old_archive_path SHA-256 mismatch"),
        (missing_hash("new"), "new_archive_path SHA-256 mismatch"),
        (C("_leaks"), "extension_id appears in multiple experiment splits"),
    )
    warnings = reasons((known & ~allowed_for_training(have("label")), _quoted("label", have("label"), " must be excluded from supervised training")))
    return joined.select("pair_id", "extension_id", errors.alias("errors"), warnings.alias("warnings"))


def provisional_label(sensitive: Column, hosts: Column, connectable: Column, background: Column, background_is_risky: bool) -> Column:
    """Label from manifest evidence alone; the earlier variant calls a new background risky, the later ones uncertain."""
    expanded = sensitive | hosts | connectable
    return (
        F.when(expanded, "risky_transition")
        .when(background, "risky_transition" if background_is_risky else "uncertain")
        .otherwise("benign_transition")
    )


def provisional_labels(summary: DataFrame, background_is_risky: bool = False) -> DataFrame:
    """Provisional label and confidence of drift summaries."""
    label = provisional_label(
        C("added_sensitive_permission_count") > 0, C("added_host_count") > 0, C("externally_connectable_changed"),
        C("background_added"), background_is_risky,
    )
    return summary.select("pair_id", label.alias("label")).withColumn(
        "label_confidence", F.when(C("label") == "uncertain", "low").otherwise("medium")
    )


def external_holdout(records: DataFrame, flag: str = vocab.EXTERNAL_HOLDOUT_NOTE) -> DataFrame:
    """Records whose notes carry the holdout flag."""
    return records.where(F.array_contains("notes", flag))


def without_holdout(features: DataFrame, holdout: DataFrame, key: str = "record_id") -> DataFrame:
    """Feature rows that do not belong to a holdout record."""
    return features.join(holdout.select(key).distinct(), key, "left_anti")


def merge_records(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Previous corpus and new records as one table; columns of either side are kept."""
    return previous.unionByName(new, allowMissingColumns=True)


def snapshot(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per split with counts and an order-independent content hash, plus a row for all.

    The hash is the sum, over the rows, of the first 15 hexadecimal digits of the SHA-256 of the fields as
    text, in order of their names unless `fields` names them.
    """
    kinds = {field.name: field.dataType for field in records.schema.fields}
    as_text = lambda name: F.to_json(name) if isinstance(kinds[name], (T.StructType, T.ArrayType, T.MapType)) else C(name).cast("string")
    text = F.concat_ws("\u001f", *[F.coalesce(as_text(name), F.lit("")) for name in fields or sorted(records.columns)])
    eligible = F.coalesce(C("eligible_for_supervised_training"), F.lit(False))
    hashed = records.withColumn("_row", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    return (
        hashed.groupingSets([["split"], []], "split")
        .agg(
            F.grouping("split").alias("is_total"),
            F.count("*").alias("records"),
            F.count_if(eligible).alias("eligible"),
            F.count_distinct("extension_id").alias("extensions"),
            F.count_if(C("label") == "uncertain").alias("uncertain"),
            F.sum("_row").cast("string").alias("content_sum"),
        )
        .select(
            F.when(C("is_total") == 1, "all").otherwise(F.coalesce("split", F.lit("unsplit"))).alias("split"),
            "records", "eligible", "extensions", "uncertain", "content_sum",
        )
    )


def replication_conclusion(comparison: DataFrame, new_records: Column, needed: int = 16, recall: float = 0.8) -> DataFrame:
    """Conclusion from the side-by-side rule metrics {old_fpr, new_fpr, new_recall}."""
    supported = (new_records >= needed) & (C("new_recall") >= recall) & (C("new_fpr") <= C("old_fpr"))
    return comparison.withColumn("conclusion", F.when(supported, "PARTIALLY_SUPPORTED").otherwise("INCONCLUSIVE"))
