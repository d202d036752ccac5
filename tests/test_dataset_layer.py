"""Intake, audits, splits and readiness on written records."""
import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.operators import audits, curation, features, splits

_SCHEMA = """record_id string, extension_id string, extension_name string, source_reference string, label_rationale string, source_type string,
license_status string, license string, label string, label_source string, label_review_status string, label_quality_tier string, old_path string, new_path string,
old_version string, new_version string, old_timestamp string, new_timestamp string, old_expected_sha256 string, old_extension_id string, new_extension_id string, split string"""
_GOOD = dict(
    record_id="r", extension_id="e", extension_name="E", source_reference="s", label_rationale="because", source_type="real_public",
    license_status="allowed", license="MIT", label="benign_transition", label_source="repository_documented_change", label_review_status="reviewed",
    label_quality_tier=None, old_path="a.zip", new_path="b.zip", old_version="1.0", new_version="1.1", old_timestamp=None, new_timestamp=None,
    old_expected_sha256=None, old_extension_id=None, new_extension_id=None, split="train",
)


def _intake(spark, *changes):
    names = [part.split()[0] for part in _SCHEMA.replace("\n", " ").split(",")]
    rows = [tuple({**_GOOD, "record_id": f"r{i}", **change}[name] for name in names) for i, change in enumerate(changes)]
    packages = spark.createDataFrame(
        [("a.zip", "aa", "Name", None), ("b.zip", "bb", "Name", None), ("c.zip", "cc", "Other", None), ("bad.zip", None, None, "package is not a valid ZIP/CRX-compatible archive")],
        "path string, sha256 string, manifest_name string, problem string",
    )
    records = curation.attach_packages(spark.createDataFrame(rows, _SCHEMA), packages)
    return {row.record_id: row for row in curation.intake(records).collect()}


def test_intake_stages_and_reasons(spark):
    rows = _intake(
        spark, {}, {"license_status": "unknown"}, {"extension_name": ""}, {"label": "uncertain"}, {"new_path": "c.zip"}, {"new_path": None},
        {"new_path": "gone.zip"}, {"new_path": "bad.zip"}, {"old_expected_sha256": "zz"}, {"old_expected_sha256": "AA"},
        {"old_extension_id": "x", "new_extension_id": "y"}, {"new_version": "0.9"}, {"new_version": "next"}, {"new_timestamp": "bad"},
        {"label_quality_tier": "BEST"}, {"label_source": vocab.OWN_SCORE_SOURCE}, {"source_type": "unknown/unverified"}, {"label": "excluded"},
    )
    stage = [(rows[f"r{i}"].stage, rows[f"r{i}"].quality_status) for i in range(len(rows))]
    assert stage[0] == ("ACCEPTED", "COMPLETE") and rows["r0"].eligible_for_supervised_training
    assert rows["r0"].label_quality_tier == "SINGLE_REVIEWER_PROVISIONAL"
    assert stage[1] == ("QUARANTINED", "QUESTIONABLE") and stage[2] == ("EXCLUDED", "REJECTED")
    assert stage[3] == ("ACCEPTED", "QUESTIONABLE") and not rows["r3"].eligible_for_supervised_training
    assert stage[4] == ("ACCEPTED", "QUESTIONABLE") and "manifest names differ" in rows["r4"].warnings[0]
    assert rows["r5"].reasons == ["missing new package path"]
    assert rows["r6"].reasons == ["new package path does not exist"]
    assert rows["r7"].reasons == ["new package is not a valid ZIP/CRX-compatible archive"]
    assert rows["r8"].reasons == ["old package SHA-256 mismatch"] and rows["r9"].reasons == []
    assert rows["r10"].reasons == ["old/new extension IDs do not match"]
    assert rows["r11"].reasons == ["old/new version order is not longitudinal"]
    assert rows["r12"].reasons == ["version order cannot be established"]
    assert rows["r13"].reasons == ["new timestamp is invalid"]
    assert rows["r14"].reasons == ["invalid label_quality_tier 'BEST'"] and rows["r14"].label_quality_tier == "UNCERTAIN"
    assert rows["r15"].reasons == ["invalid label_source 'engine_score'", "label_source must not be the engine's own score"]
    assert stage[16][0] == "QUARANTINED" and rows["r17"].reasons == ["label is excluded"]


def _pairs(spark, rows):
    return spark.createDataFrame(
        rows, "pair_id string, extension_id string, old_version string, new_version string, old_sha256 string, new_sha256 string, split string, label string, eligible_for_supervised_training boolean, controlled_mutation_type string"
    )


def test_adjacent_reuse_is_not_a_duplicate(spark):
    rows = _pairs(spark, [
        ("p1", "e", "1", "2", "h1", "h2", "train", "benign_transition", True, None), ("p2", "e", "2", "3", "h2", "h3", "train", "benign_transition", True, None),
        ("p3", "f", "1", "2", "h9", "h3", "test", "risky_transition", True, "m"), ("p3", "f", "1", "2", None, None, "validation", "risky_transition", True, "m"),
    ])
    flags = {row.sha256: row.adjacent_reuse for row in audits.repeated_hashes(rows).collect()}
    assert flags == {"h2": True, "h3": False}
    report = audits.duplicate_report(rows).first()
    assert (report.duplicate_record_ids, report.duplicate_pairs, report.duplicate_package_hashes, report.adjacent_version_reuse, report.passed) == (1, 1, 1, 1, False)
    assert audits.repeated_hash_members(rows).count() == 4
    leaks = {(row.type, row.key): row.splits for row in audits.split_leakage(rows).collect()}
    assert leaks == {
        ("extension_group", "f"): ["test", "validation"], ("package_hash", "h3"): ["test", "train"], ("controlled_mutation_family", "f:m"): ["test", "validation"],
    }
    quality = audits.split_quality(rows).first()
    assert quality.block_reasons == ["test split contains fewer than five records", "test split contains fewer than two extension identities", "protected split leakage detected"]
    assert quality.median_pairs == 2.0 and quality.unique_extensions == 2


def test_record_validation(spark):
    rows = _pairs(spark, [
        ("p1", "e", "1", "2", "h1", "h2", "train", "benign_transition", True, None), ("p1", "e", "", "3", "h2", "h3", "test", "controlled_malicious_transition", True, None),
        ("p2", "g", "1", "2", "h4", "h5", vocab.HOLDOUT_SPLIT, "bad", True, None), ("p3", "g", "1", "2", "h6", "h7", "elsewhere", "uncertain", True, None),
    ]).withColumns({name: F.lit("x") for name in ("extension_name", "old_archive_path", "new_archive_path", "source", "license", "label_rationale", "source_type", "source_uri")}).withColumn("collection_timestamp", F.lit("2024-01-01"))
    checked = curation.validate(rows).orderBy("pair_id").collect()
    second = next(row for row in checked if "missing old_version" in row.errors)
    assert second.errors == ["missing old_version", "controlled malicious label requires controlled_mutation_type", "duplicate pair_id", "extension_id appears in multiple experiment splits"]
    assert [row.errors for row in checked if row.pair_id == "p2"] == [["invalid label 'bad'"]]
    third = next(row for row in checked if row.pair_id == "p3")
    assert third.errors == ["invalid split 'elsewhere'"] and len(third.warnings) == 1


def test_splits_keep_groups_together(spark):
    records = spark.range(400).select((F.col("id") % 40).cast("string").alias("extension_id"), F.when(F.col("id") % 40 != 3, F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("new_timestamp"))
    for assign in (splits.random_group_split, splits.chronological_group_split):
        sizes = {row.split: row["count"] for row in assign(records).groupBy("split").count().collect()}
        assert sizes == {"train": 28, "validation": 6, "test": 6}
    assert splits.chronological_group_split(records).where("extension_id = '3'").first().split == "test"
    assert sorted(splits.random_group_split(records).collect()) == sorted(splits.random_group_split(records).collect())
    with pytest.raises(ValueError):
        splits.random_group_split(records, 0.5, 0.1, 0.1)
    with pytest.raises(Exception, match="missing split assignment"):
        splits.apply_split(records, spark.createDataFrame([("1", "train")], "extension_id string, split string"), required=True).collect()


def test_names_labels_and_gates(spark):
    assert audits.feature_name_leaks(vocab.feature_names()) == []
    assert audits.feature_name_leaks(["risk_score_x"]) == [("risk_score_x", "risk_score")]
    assert audits.review_metadata_leaks(["gold_flag", "added_host_count", "label"], ["reviewer_id"]) == ["gold_flag"]
    with pytest.raises(Exception, match="not binary-evaluable"):
        spark.createDataFrame([("uncertain",)], "label string").select(features.binary_label(F.col("label"))).collect()
    with pytest.raises(ValueError):
        features.without_family([], "unknown")
    facts = spark.createDataFrame([(10, 5, 3, 0, False)], "real_record_count int, unique_extension_count int, provisional_count int, uncertain_tier_count int, leakage_passed boolean")
    facts = facts.withColumns({"validation_passed": F.lit(True), "duplicates_passed": F.lit(True), "missing_analyzer_count": F.lit(0)})
    row = audits.gate(facts, audits.GATES["maturation_60"]).first()
    assert row.block_reasons == ["protected split leakage detected"] and not row.ready and len(row.warnings) == 3
