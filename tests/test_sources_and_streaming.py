"""Sources, sinks and the streaming form."""
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.operators import features
from deltascope.plans.pairs import PairAnalysis
from deltascope.sources import feature_tables, manifests, packages, releases, reports, results
from deltascope.streaming import pairs as streaming
from tests import samples


def _zip(entries, compression=zipfile.ZIP_STORED, links=()):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", compression) as archive:
        for name, body in entries.items():
            info = zipfile.ZipInfo(name)
            info.compress_type = compression
            if name in links:
                info.external_attr = 0o120777 << 16
            archive.writestr(info, body)
    return buffer.getvalue()


def test_archive_quotas(spark):
    archives = {
        "good": _zip({"manifest.json": "{}", "a.js": "x"}), "slip": _zip({"../evil.js": "x"}), "many": _zip({f"f{i}": "" for i in range(1001)}),
        "bomb": _zip({"a.txt": "0" * 200_000}, zipfile.ZIP_DEFLATED), "link": _zip({"l": "target"}, links=["l"]), "broken": b"not a zip",
    }
    frame = spark.createDataFrame([(name, bytearray(raw)) for name, raw in archives.items()], "package_id string, raw binary")
    files, verdicts = packages.ingest_archives(frame)
    rejected = {row.package_id: row.rejected for row in verdicts.collect()}
    assert rejected == {
        "good": None, "slip": "path traversal: ../evil.js", "many": "archive exceeds maximum file count limit", "bomb": "high compression ratio",
        "link": "symbolic link: l", "broken": "invalid zip archive format",
    }
    assert sorted((row.package_id, row.path, row.ext) for row in files.collect()) == [("good", "a.js", ".js"), ("good", "manifest.json", ".json")]


def test_folders_archives_and_roots(spark, tmp_path):
    for path, body in {"p1/manifest.json": b"{}", "p1/js/Main.JS": b"a\xffb", "p2/pkg/manifest.json": b"{}", "p2/pkg/x": b"1", "p2/other": b"2"}.items():
        target = tmp_path / "unpacked" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    files = packages.scan_folders(spark, str(tmp_path / "unpacked"))
    rows = {(row.package_id, row.path): row for row in files.collect()}
    assert rows[("p1", "js/Main.JS")].ext == ".js" and rows[("p1", "js/Main.JS")].size == 3 and rows[("p1", "js/Main.JS")].content == "ab"
    moved = {(row.package_id, row.path) for row in packages.normalise_roots(files).collect()}
    assert moved == {("p1", "manifest.json"), ("p1", "js/Main.JS"), ("p2", "manifest.json"), ("p2", "x")}
    assert packages.package_hashes(files).count() == 2
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "one.zip").write_bytes(_zip({"manifest.json": "{}"}))
    ingested, _ = packages.ingest_archives(packages.scan_archives(spark, str(tmp_path / "z")))
    assert ingested.first().package_id == "one"


def test_manifest_cases(spark):
    texts = {
        "v2": {"permissions": ["tabs", "http://a.com/*", 7], "host_permissions": ["https://b.com/*"]}, "v3": {"manifest_version": 3, "permissions": ["<all_urls>"], "host_permissions": ["<all_urls>", "https://b.com/*"]},
        "empty": {},
    }
    frame = spark.createDataFrame([*[(k, json.dumps(v)) for k, v in texts.items()], ("bad", "{no")], "package_id string, manifest string")
    rows = {row.package_id: row for row in manifests.project_manifests(frame).collect()}
    assert rows["v2"].permissions == ["tabs"] and rows["v2"].hosts == ["http://a.com/*"] and rows["v2"].manifest_version == 2
    assert rows["v3"].hosts == ["<all_urls>", "https://b.com/*"]
    assert rows["empty"].name == "Unknown Extension" and rows["empty"].version == "1.0" and rows["empty"].background == "{}"
    assert not rows["bad"].manifest_is_valid and rows["bad"].permissions == []


def test_import_manifest(spark, tmp_path):
    body = {"dataset_version": "d1", "records": [{"record_id": "r1", "extension_id": "e", "old": {"path": "a.zip", "version": "1"}, "new": {"path": "b.zip", "version": "2", "timestamp": "2024-01-01"}, "notes": ["n"]}]}
    (tmp_path / "m.json").write_text(json.dumps(body, indent=1))
    row = manifests.read_import_manifest(spark, str(tmp_path / "m.json")).first()
    assert row.dataset_version == "d1" and row.old.version == "1" and row.new.timestamp == "2024-01-01" and row.notes == ["n"]


def test_feature_artifacts_round_trip(spark, tmp_path):
    pairs = samples.pairs(spark).withColumns({"label": F.lit("benign_transition"), "split": F.lit("train"), "source_type": F.lit("real_public")})
    table = PairAnalysis(pairs, samples.files(spark)).features.persist()
    out = str(tmp_path / "features")
    paths = feature_tables.write_feature_artifacts(table, out, dataset_id="d", dataset_version="v1")
    assert len(paths) == 13
    back = feature_tables.read_features(spark, f"{out}/{vocab.FULL_DIFFERENTIAL}.csv")
    assert len(back.columns) == 19 + 43
    keys = ["record_id", *vocab.feature_names(vocab.FULL_DIFFERENTIAL)]
    assert sorted(back.select(*keys).collect()) == sorted(features.projection(table, vocab.FULL_DIFFERENTIAL).select(*keys).collect())
    manifest = spark.read.json(f"{out}/extraction_manifest.json")
    assert feature_tables.reusable(manifest, "v1", 2) and not feature_tables.reusable(manifest, "v2", 2)
    failed = spark.createDataFrame([("x",)], "record_id string")
    with pytest.raises(ValueError, match="failed extraction"):
        feature_tables.write_feature_artifacts(table, out, failed, dataset_id="d", dataset_version="v1")
    summary = {(row.dimension, row.value): row.records for row in feature_tables.dataset_summary(table).collect()}
    assert summary == {("label", "benign_transition"): 2, ("split", "train"): 2}


def test_result_table(spark, tmp_path):
    path = str(tmp_path / "results")
    scored = spark.createDataFrame([("p1", 10.0), ("p2", 20.0)], "pair_id string, risk_score double")
    results.append_results(scored, path, "2024-01-01 00:00:00")
    results.append_results(spark.createDataFrame([("p3", 30.0)], "pair_id string, risk_score double"), path, "2024-01-02 00:00:00")
    assert results.result_of(spark, path, "p2").first().risk_score == 20.0
    assert [row.pair_id for row in results.latest_results(spark, path, 2).collect()] == ["p3", "p1"]


def test_release_assets_take_the_first_match(spark):
    assets = spark.createDataFrame([("s", "r1", 0, "source.zip"), ("s", "r1", 1, "my-chrome-1.zip"), ("s", "r1", 2, "ext.zip"), ("s", "r2", 0, "other.txt")], "source_id string, release string, position int, name string")
    specs = spark.createDataFrame([("s", "ext.zip", "chrome", "", ".zip")], "source_id string, asset_name string, asset_contains string, asset_prefix string, asset_suffix string")
    assert [(row.release, row.name) for row in releases.select_assets(assets, specs).collect()] == [("r1", "my-chrome-1.zip")]


def test_release_assets_of_one_source_stay_in_their_tasks(spark):
    assets = spark.range(1000).selectExpr("concat('s', id % 1) source_id", "id release", "1 position", "'ext.zip' name")
    specs = spark.createDataFrame([("s0", "ext.zip", "", "", "")], "source_id string, asset_name string, asset_contains string, asset_prefix string, asset_suffix string")
    chosen = releases.select_assets(assets, specs)
    plan = chosen._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert chosen.count() == 1000


def test_curation_reports(spark, tmp_path):
    from deltascope.operators import curation

    records = spark.createDataFrame(
        [("r1", "e", "E", "s", "why", "real_public", "allowed", "MIT", "benign_transition", "repository_documented_change", "reviewed", "1", "2", "h1", "h2", "train"),
         ("r2", "e", "", "s", "why", "real_public", "unknown", "MIT", "benign_transition", "repository_documented_change", "reviewed", "1", "2", "h1", "h2", "train")],
        "record_id string, extension_id string, extension_name string, source_reference string, label_rationale string, source_type string, license_status string, license string, label string, label_source string, label_review_status string, old_version string, new_version string, old_sha256 string, new_sha256 string, split string",
    )
    made = reports.curation_reports(curation.intake(records))
    assert set(made) == {"dataset", "provenance", "quality", "duplicate", "leakage", "license", "validation"}
    assert made["dataset"].first().quarantined == 1 and made["duplicate"].first().passed
    paths = reports.write_reports(made, str(tmp_path / "reports"))
    assert spark.read.json(paths["validation"]).first().record_id == "r2"


def test_arriving_pairs_score_as_in_batch(spark, tmp_path):
    files = samples.files(spark).persist()
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    columns = ("pair_id", "extension_id", "old_package_id", "new_package_id")
    drop = lambda name, rows: (inbox / name).write_text("\n".join(json.dumps(dict(zip(columns, row))) for row in rows))
    load = lambda wanted: files.join(wanted, "package_id", "left_semi")

    def run():
        streaming.score_arriving(streaming.arriving_pairs(spark, str(inbox)), load, out, state).awaitTermination()
        return {row.pair_id: row.risk_score for row in streaming.stored_results(spark, out).collect()}

    drop("1.json", samples.PAIRS[:1])
    assert run() == {"plain": 0.0}
    drop("2.json", samples.PAIRS)  # the first pair arrives again
    assert run() == {"plain": 0.0, "risky": 100.0}
    assert streaming.stored_results(spark, out).count() == 2
