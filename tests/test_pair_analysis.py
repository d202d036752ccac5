import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.operators import drift, features
from deltascope.plans.pairs import PairAnalysis
from tests import samples


@pytest.fixture(scope="module")
def analysis(spark):
    return PairAnalysis(samples.pairs(spark), samples.files(spark))


def test_sample_pairs_reach_the_scores_worked_out_by_hand(analysis):
    rows = {row.pair_id: row for row in analysis.scores.collect()}
    assert (rows["plain"].risk_score, rows["plain"].risk_class) == (0.0, "Low")
    risky = rows["risky"]
    assert (risky.risk_score, risky.risk_class, risky.raw_score) == (100.0, "Critical", 109.5)
    assert [
        risky.permission_contribution, risky.host_contribution, risky.api_contribution, risky.network_contribution,
        risky.obfuscation_contribution, risky.structural_contribution, risky.combination_contribution,
    ] == [
        18.0,  # (scripting 25 + tabs 15) * 0.45
        25.0,  # all hosts
        8.0,  # two API names
        8.0,  # one external address
        7.5,  # a timer with a text, 15 * 0.5
        23.0,  # a flow 22, a function 1
        20.0,  # scripting with all hosts 15, a worker 5
    ]
    assert risky.confidence == 1.0
    assert [rule.rule_id for rule in risky.triggered_rules] == [
        "RULE_CRITICAL_SOURCE_SINK_HEURISTIC", "RULE_CRITICAL_GLOBAL_SENSITIVE_CREEP", "RULE_HIGH_OBFUSCATION_INTRODUCED",
        "RULE_HIGH_NEW_EXTERNAL_NETWORK", "RULE_CRITICAL_PERM_ADDED", "RULE_MODERATE_NEW_BACKGROUND_WORKER",
    ]


def test_findings_of_the_risky_pair(analysis):
    found = analysis.findings.where("pair_id = 'risky'").orderBy("position").collect()
    assert [row.category for row in found] == [
        "code_structure", "host_access", "permissions", "browser_apis", "network", "obfuscation", "background",
    ]
    assert found[4].new_value == "wss://sink.example.org:9443/in"
    assert (found[4].severity, found[4].evidence) == ("High", "Destination extracted in watch.js at line 2: 'wss://sink.example.org:9443/in'.")
    assert found[2].evidence == "Added permissions: scripting, tabs."


def test_feature_rows(analysis):
    rows = {row.record_id: row for row in analysis.features.collect()}
    risky, plain = rows["risky"], rows["plain"]
    assert len(vocab.feature_names()) == 57
    assert [len(vocab.feature_names(name)) for name in vocab.PROJECTIONS] == [8, 18, 18, 13, 43]
    assert risky.added_permission_count == 2 and risky.permission_risk_delta == 40
    assert risky.all_urls_introduced == 1 and risky.host_scope_score_delta == 90
    assert risky.service_worker_introduced == 1 and risky.decoded_endpoint_addition_count == 0
    assert risky.added_api_count == 2 and risky.critical_api_added == 0
    assert risky.file_count_delta == 1 and risky.js_file_count_delta == 1
    assert risky.dynamic_execution_added_count == 1 and risky.added_obfuscation_score == 15
    assert plain.modified_file_count == 3 and plain.added_permission_count == 0
    assert all(getattr(risky, f"{name}_available") == 1 for name in vocab.ANALYZERS)


def test_failed_analyzer_differs_from_zero(spark):
    errors = spark.createDataFrame([("risky", "api_analyzer", "boom")], "pair_id string, analyzer string, error string")
    analysis = PairAnalysis(samples.pairs(spark), samples.files(spark), errors=errors)
    row = analysis.features.where("record_id = 'risky'").first()
    assert row.api_analyzer_available == 0 and row.v2_sensitive_api_count == 0 and row.network_analyzer_available == 1
    scored = analysis.scores.where("pair_id = 'risky'").first()
    assert scored.confidence == 0.75 and scored.api_contribution == 0.0
    last = analysis.findings.where("pair_id = 'risky'").orderBy("position").collect()[-1]
    assert last.category == "analysis_error" and last.evidence == "boom"


def _score(spark, old, new, old_manifest=None, new_manifest=None):
    packages = {"a": samples.package(old, old_manifest), "b": samples.package(new, new_manifest)}
    analysis = PairAnalysis(samples.pairs(spark, [("p", "e", "a", "b")]), samples.files(spark, packages))
    return analysis.scores.first()


def test_layout_only_change_is_low(spark):
    row = _score(spark, "function a(){return 1}", "function a() {\n  // same\n  return 1\n}")
    assert row.risk_class == "Low"


def test_repeated_endpoint_counts_once(spark):
    row = _score(spark, "", 'fetch("https://api.example.com/x");\nfetch("https://API.example.com/x");')
    assert row.new_external_count == 1 and row.network_contribution == 8.0


def test_local_endpoint_alone_is_not_critical(spark):
    row = _score(spark, "", 'var u = "http://localhost:3000/x";')
    assert row.new_local_count == 1 and row.network_contribution == 1.0 and row.risk_class == "Low"


def test_rounding_of_every_permission_sum(spark):
    from pyspark.sql import functions as F
    from deltascope.operators.scoring import permission_part

    got = spark.range(200).select("id", permission_part(F.col("id")).alias("p")).collect()
    assert all(row.p == min(round(row.id * 0.45, 1), 25.0) for row in got)


def test_host_order_and_manifest_rules(spark):
    old = {"manifest_version": 2, "permissions": ["tabs", "https://*.example.com/*", {"x": 1}], "background": {}}
    new = {"manifest_version": 3, "permissions": ["tabs", "tabs", "idle"],
           "host_permissions": ["https://*.example.com/*", "https://*.example.com/*", "https://a.b/*"],
           "background": {"service_worker": "b.js"}, "optional_permissions": ["history"],
           "web_accessible_resources": ["a", {"resources": ["b", "c"]}], "externally_connectable": {"ids": ["*"]}}
    row = _score(spark, "", "", old, new)
    assert row.old_max_host_scope_score == 90 and row.host_scope_score_delta == 0
    assert row.new_permission_count == 3 and row.added_permissions == ["idle"] and row.new_host_count == 2
    assert row.background_added and row.externally_connectable_changed
    assert row.web_accessible_resource_change_count == 3 and row.optional_permission_change_count == 1


def test_score_from_stored_features(analysis):
    from deltascope.operators import scoring

    rebuilt = scoring.score(scoring.summary_from_features(analysis.features))
    rows = {row.record_id: row for row in rebuilt.collect()}
    assert rows["risky"].risk_score == 100.0 and rows["plain"].risk_score == 0.0


def test_projection_and_ablation(analysis):
    table = analysis.features
    assert len(features.projection(table, vocab.SIMPLE_DIFFERENTIAL).columns) == 19 + 13
    kept = features.ablate(table, "permission").columns
    assert not any("permission" in name for name in kept)


def test_single_kind_views(analysis):
    items = analysis.items
    files = {row.path: row.status for row in drift.file_drift(items).where("pair_id = 'risky'").collect()}
    assert files == {"manifest.json": "modified", "panel.html": "retained", "panel.js": "retained", "watch.js": "added"}
    levels = {row.permission: (row.status, row.level) for row in drift.permission_drift(items).where("pair_id = 'risky'").collect()}
    assert levels == {"idle": ("retained", "Low"), "scripting": ("added", "Critical"), "tabs": ("added", "High")}
    assert drift.flow_list(items).first().sources == ["tabs"]


def test_broken_pairs_fail_and_empty_ones_stay(spark):
    packages = {"good": samples.package("a"), "same": samples.package("a"), "broken": samples.package("a", None, **{"manifest.json": "{no"}), "bare": {"a.js": "x"}, "none": {"manifest.json": "{}"}}
    rows = [("ok", "e", "good", "same"), ("gone", "e", "absent", "good"), ("bad", "e", "good", "broken"), ("both", "e", "absent", "bare"), ("void", "e", "none", "none"), ("shut", "e", "good", "locked")]
    verdicts = spark.createDataFrame([("locked", "high compression ratio"), ("good", None)], "package_id string, rejected string")
    analysis = PairAnalysis(samples.pairs(spark, rows), samples.files(spark, packages), verdicts=verdicts)
    failed = {(row.pair_id, row.side): row.reason for row in analysis.failed.collect()}
    assert failed == {
        ("gone", "old"): "package is absent", ("bad", "new"): "manifest is invalid", ("both", "old"): "package is absent", ("both", "new"): "manifest is missing",
        ("shut", "new"): "high compression ratio",
    }
    scores = {row.pair_id: (row.risk_score, row.confidence) for row in analysis.scores.collect()}
    assert scores == {"ok": (0.0, 1.0), "void": (0.0, 1.0)}


def test_pair_without_facts_has_no_drift(spark):
    pairs = samples.pairs(spark, [("p", "e", "a", "b")])
    facts = PairAnalysis(pairs, samples.files(spark)).facts.limit(0)
    row = drift.summary(pairs, drift.items(pairs, facts)).first()
    assert row.added_permissions == [] and row.flows == [] and row.new_file_count == 0 and row.max_added_permission_severity == "None"
    assert not row.global_host_expansion and not row.background_added


def test_lines_spread_at_their_pairs(spark):
    """Rows that hold several facts give the items of the facts spread before."""
    from deltascope.queries import tables

    lines = spark.createDataFrame(
        [("1", "a", 2, "N|1", "Brand#1", 5, 2, "h1"), ("1", "b", 3, "N|2", "Brand#2", 10, 3, "h1"), ("2", "a", 4, "N|3", "Brand#2", 10, 3, "h2")],
        "package_id string, path string, size long, detail string, brand string, weight int, rank int, host string",
    ).withColumn("host_weight", F.lit(10)).withColumn("scope", F.lit("Specific Host"))
    pairs = spark.createDataFrame([("1->2", 1, 2), ("2->1", 2, 1)], "pair_id string, old_package_id long, new_package_id long")
    shown = ["pair_id", "kind", "key", "status", "n_old", "n_new", "old_size", "new_size", "weight", "first"]
    read = lambda items: sorted(map(str, items.select(*shown).collect()))
    whole = drift.items(pairs, lines.select("package_id", F.inline(tables.line_facts())))
    assert read(drift.items(pairs, lines, spread=tables.line_facts())) == read(whole) and whole.count() == 12
    some = drift.items(pairs, lines, spread=tables.line_facts(("permission", "host")))
    assert read(some) == read(whole.where("kind <> 'file'"))
