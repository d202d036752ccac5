"""Evidence of flows, the gate before training, the last-stage gate, and chronological order."""
import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.operators import audits, facts, splits
from deltascope.plans import experiment
from tests import samples

FLOW = "// cookies below\n\tchrome.cookies.getAll(x);\nlet a = 'fetch(';\nfetch('y'); chrome.history.search(q)\nfetch(u)"


def test_flow_evidence_has_every_line(spark):
    files = samples.files(spark, {"p": {"a.js": FLOW, "b.js": "fetch('z')", "c.html": FLOW, "d.js": ""}})
    files = files.unionByName(files.where("path = 'b.js'").withColumns({"path": F.lit("n.js"), "content": F.lit(None).cast("string")}))
    (row,) = facts.file_flows(files).collect()
    as_tuples = lambda items: [(item.name, item.line, item.snippet) for item in items]
    assert row.path == "a.js" and row.sources == ["cookies", "history"] and row.sinks == ["fetch"]
    both = "fetch('y'); chrome.history.search(q)"
    assert as_tuples(row.source_evidence) == [("cookies", 2, "chrome.cookies.getAll(x);"), ("history", 4, both)]
    assert as_tuples(row.sink_evidence) == [("fetch", 4, both), ("fetch", 5, "fetch(u)")]
    assert row.severity == "Critical" and row.confidence == 0.75 and row.claim == vocab.FLOW_CLAIM
    assert row.pattern == "Heuristic source (cookies, history) near sink (fetch)"


def test_flow_evidence_agrees_with_facts_and_needs_no_shuffle(spark):
    files = samples.files(spark, {"p": {"a.js": FLOW}, "q": {"a.js": "x\n" * 5000 + FLOW + " " * 300 + "y"}})
    columns = ("package_id", "path", "sources", "sinks", "severity", "pattern")
    found = facts.file_flows(files)
    assert sorted(found.select(*columns).collect()) == sorted(facts.flows(facts.script_facts(files)).select(*columns).collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert max(len(item.snippet) for row in found.collect() for item in row.sink_evidence) <= 120
    assert facts.file_flows(files.limit(0)).count() == 0


def _rows(spark, changes=()):
    rows = {i: [f"r{i}", f"e{i // 4}", "risky_transition" if i % 4 == 0 else "benign_transition", ["train", "validation", "test"][i // 4 % 3], f"o{i}", f"n{i}"] for i in range(36)}
    for at, column, value in changes:
        rows[at][column] = value
    return spark.createDataFrame(list(rows.values()), "record_id string, extension_id string, label string, split string, old_sha256 string, new_sha256 string")


def test_gate_before_training(spark):
    verdict = lambda rows, **other: audits.supervised_gate(rows, **other).first()
    good = _rows(spark)
    assert verdict(good, provenance=good).ready and verdict(good).block_reasons == []
    overlap = _rows(spark, [(0, 4, "same"), (5, 5, "same")])
    assert verdict(overlap).ready
    assert verdict(overlap, provenance=overlap).block_reasons == ["a package hash is in more than one split"]
    twice = _rows(spark, [(1, 4, "o0"), (1, 5, "n0"), (2, 4, None), (2, 5, ""), (3, 4, None), (3, 5, "")])
    assert verdict(twice, provenance=twice).block_reasons == ["a transition occurs more than once"]
    assert verdict(_rows(spark, [(0, 3, "test")])).block_reasons == ["an extension is in more than one split"]
    few = good.where("extension_id in ('e0', 'e1')")
    assert verdict(few).block_reasons == ["fewer than 20 eligible supervised records", "fewer than 6 eligible extension groups", "test split lacks both binary target classes"]
    empty = verdict(good.limit(0), provenance=good.limit(0))
    assert not empty.ready and len(empty.block_reasons) == 5 and empty.eligible_count == 0
    assert not verdict(_rows(spark, [(i, 3, None) for i in range(36)])).ready


def test_experiment_stops_at_its_gate(spark):
    rows = _rows(spark).withColumns({"eligible_for_supervised_training": F.lit(True), "added_permission_count": F.lit(1.0)})
    experiment.gate_or_raise(rows.drop("old_sha256", "new_sha256"))
    with pytest.raises(ValueError, match="fewer than 20 eligible supervised records; fewer than 6"):
        experiment.gate_or_raise(rows.where("extension_id in ('e0', 'e1', 'e2')").drop("old_sha256", "new_sha256"))
    with pytest.raises(ValueError, match="a package hash is in more than one split"):
        experiment.run(rows.drop("old_sha256", "new_sha256"), provenance=_rows(spark, [(0, 4, "s"), (5, 5, "s")]))
    with pytest.raises(ValueError, match="group split audit failed"):
        experiment.rule_experiment(_rows(spark, [(0, 3, "test")]).drop("old_sha256", "new_sha256").withColumn("eligible_for_supervised_training", F.lit(True)))


def test_last_stage(spark):
    schema = "record_id int, extension_id string, label string, label_quality_tier string"
    tier = "MULTI_REVIEWER_ADJUDICATED"
    records = spark.createDataFrame([(i, f"e{i % 4}", "malicious_transition" if i < 12 else "benign_transition", tier) for i in range(20)] + [(20, None, None, None)], schema)
    gold = spark.createDataFrame([("real",), ("controlled",), ("real",)], "real_or_controlled string")
    holdout = spark.createDataFrame([(13,), (14,), (15,), (15,), (99,)], "record_id int")
    read = spark.createDataFrame([("a", "INITIAL_BLIND"), ("b", "SECOND_BLIND"), (None, "SECOND_BLIND")], "reviewer_id string, review_round string")
    passed = {f"{name}_passed": F.lit(True) for name in ("names", "duplicates", "leakage")}
    row = audits.last_stage_readiness(audits.last_stage_facts(records, gold, holdout, read).withColumns(passed)).first()
    assert (row.record_count, row.malicious_candidates, row.confirmed_malicious_count, row.provisional_count) == (21, 12, 12, 0)
    assert (row.real_gold_count, row.controlled_gold_count, row.holdout_count, row.holdout_extensions, row.holdout_provisional_count, row.later_reviews) == (2, 1, 3, 3, 0, 1)
    assert row.block_reasons == [] and not row.ready
    assert [name for name, _ in audits.LAST_STAGE_CHECKS if not row[name]] == ["external_holdout_ground_truth_sufficient", "provisional_label_dependence_acceptable"]
    none = audits.last_stage_facts(records.limit(0), gold.limit(0), holdout.limit(0), read.limit(0))
    row = audits.last_stage_readiness(none.withColumns({**passed, "leakage_passed": F.lit(None).cast("boolean")})).first()
    assert len(row.block_reasons) == 4 and not row.leakage_audit_clean and not row.defensible_real_gold_set_exists


def test_chronological_order(spark):
    rows = spark.createDataFrame([(1, "2024-03-01"), (2, "2024-01-05T10:00:00Z"), (3, "2024-02-01")], "record_id int, new_timestamp string")
    assert [row.record_id for row in splits.chronological_order(rows).collect()] == [2, 3, 1]
    with pytest.raises(Exception, match="all rows must have valid new_timestamp values"):
        splits.chronological_order(rows.union(spark.createDataFrame([(4, None)], rows.schema))).collect()
