"""Queries that once did a smaller job than their operators."""
import pytest

from deltascope import vocab
from deltascope.operators import models, reviews
from deltascope.plans import experiment
from deltascope.queries import curation_queries, drift_queries
from tests.check_queries import connect, differences


def test_packets_hold_all_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b {"), (2, 3, "user", "no first turn"), (2, 3, "user", "same turn"), (3, None, "user", "c")]
    packets = curation_queries.conversation_packets(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    fields = {(r.record_id, r.field) for r in reviews.packet_fields(packets).collect()}
    assert {(k, "diff.body") for k in (1, 2, 3)} | {(1, "turn"), (2, "turn")} <= fields
    assert {(1, "turns.0.body"), (1, "turns.1.body"), (2, "turns.1.body"), (3, "turns.0.body")} <= fields
    assert all(text in p for p, text in zip([r.packet for r in packets.orderBy("record_id").collect()], ("b {", "same turn", '"c"')))
    assert differences(spark, connect("/root/testdata/sf0.001"), "strict_review_validation", "/root/testdata/sf0.001") is None


class Planned(Exception):
    pass


@pytest.mark.parametrize("name", ["forest_predictions", "forest_selection", "logistic_weights", "logistic_selection", "family_importance", "model_experiment"])
def test_model_queries_use_whole_grids_and_all_projections(monkeypatch, name):
    def stop(rows, plans, seed=1337):
        raise Planned(plans)

    monkeypatch.setattr(curation_queries, "_training_rows", lambda spark, sf_dir: None)
    monkeypatch.setattr(experiment, "gate_or_raise", lambda rows: None)
    monkeypatch.setattr(models, "train_grids", stop)
    with pytest.raises(Planned) as caught:
        curation_queries.QUERIES[name](None, "")
    (plans,) = caught.value.args
    assert all(plan.grid == models.candidates(plan.model) for plan in plans)
    if name == "model_experiment":
        assert [(plan.names, plan.model) for plan in plans] == [(vocab.feature_names(p), m) for p in vocab.PROJECTIONS for m in experiment.MODELS]
    else:
        assert [plan.model for plan in plans] == ["random_forest" if name.startswith("forest") else "logistic_regression"]


@pytest.mark.parametrize("name", ["capability_sets", "baseline_rules", "review_score"])
def test_versions_are_ordered_once(spark, name):
    plan = drift_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" not in plan and "l_partkey" in plan


@pytest.mark.parametrize("name", ["error_attribution", "error_breakdown"])
def test_errors_read_stored_features(spark, name):
    plan = drift_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan
