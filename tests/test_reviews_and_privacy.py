"""Review tables and privacy checks."""
import json

import pytest
from pyspark.sql import functions as F

from deltascope import vocab
from deltascope.functions import ids
from deltascope.operators import privacy, reviews

_REVIEW = "review_id string, reviewer_id string, record_id string, review_round string, independent_label string, confidence string, rationale string, evidence_references array<string>, blind_review boolean, review_timestamp string, review_status string"


def _review(**changes):
    row = dict(
        review_id="HRV1::h1::r1::INITIAL_BLIND", reviewer_id="h1", record_id="r1", review_round="INITIAL_BLIND", independent_label="RISKY_TRANSITION",
        confidence="HIGH", rationale="because", evidence_references=["diff.hosts"], blind_review=True, review_timestamp="2024-01-01T00:00:00Z", review_status="SUBMITTED",
    )
    row.update(changes)
    return tuple(row.values())


def test_strict_form(spark):
    packets = spark.createDataFrame([("r1", json.dumps({"diff": {"hosts": [{"x": 1}], "deep": {"a": 1}}, "note": "{ \"b\": 1 }"}))], "record_id string, packet string")
    fields = reviews.packet_fields(packets)
    assert {row.field for row in fields.collect()} == {"diff", "diff.hosts", "diff.deep", "diff.deep.a", "note"}
    rows = [_review(), _review(review_id="x", independent_label="SAFE", rationale=" "), _review(evidence_references=["diff.gone"], blind_review=False, review_id="HRV1::h1::r1::INITIAL_BLIND2"), _review(record_id="r9", review_timestamp="yesterday")]
    checked = [row.errors for row in reviews.strict_errors(spark.createDataFrame(rows, _REVIEW).withColumn("n", F.monotonically_increasing_id()), fields, "h1").orderBy("n").collect()]
    assert checked[0] == []
    assert checked[1] == ["independent_label is invalid", "rationale is required", "review_id must equal the preassigned governed review ID"]
    assert "every evidence reference must resolve to a packet field" in checked[2] and "blind_review must be true" in checked[2]
    assert "submission record_id does not match packet record_id" in checked[3] and "review_timestamp must be a valid ISO-8601 timestamp" in checked[3]


def test_basic_form_rejects_machines(spark):
    rows = spark.createDataFrame([_review(reviewer_id="AI"), _review(confidence="SURE")], _REVIEW)
    assert [row.errors for row in reviews.basic_errors(rows).collect()] == [["AI assistance cannot be represented as an independent reviewer"], ["invalid confidence"]]


def test_ids(spark):
    one = spark.range(1)
    assert one.select(reviews.review_id(F.lit("h1"), F.lit("r"), F.lit("A"))).first()[0] == "HRV1::h1::r::A"
    with pytest.raises(Exception, match="must be nonempty"):
        one.select(ids.joined_id("X", F.lit("a::b"))).collect()
    with pytest.raises(Exception, match="empty after sanitization"):
        one.select(ids.safe_name(F.lit("..//.."))).collect()
    import hashlib

    body = json.dumps({"b": 1, "a": "x"}, sort_keys=True, separators=(",", ":"))
    assert one.select(ids.canonical_hash(F.struct(F.lit(1).alias("b"), F.lit("x").alias("a")))).first()[0] == hashlib.sha256(body.encode()).hexdigest()


def test_release_gate_and_concordance(spark):
    expected = spark.createDataFrame([("a", "1"), ("b", "2")], "record_id string, packet_sha256 string")
    good = spark.createDataFrame([("a", []), ("b", [])], "record_id string, errors array<string>")
    assert reviews.release_gate(expected, expected, good).count() == 0
    packets = spark.createDataFrame([("a", "9"), ("c", "3")], "record_id string, packet_sha256 string")
    bad = spark.createDataFrame([("a", ["x"])], "record_id string, errors array<string>")
    errors = {(row.record_id, row.error) for row in reviews.release_gate(expected, packets, bad).collect()}
    assert errors == {("a", "packet hash changed"), ("a", "x"), ("b", "packet is missing"), ("c", "packet ID differs from the governed manifest")}
    unknown = reviews.concordance(spark.createDataFrame([_review()], _REVIEW), spark.createDataFrame([("zz", "uncertain")], "record_id string, label string"))
    with pytest.raises(Exception, match="absent from the dataset"):
        unknown.collect()


def test_priority_reasons(spark):
    names = [name for name, _, _ in vocab.PRIORITY_FEATURES]
    rows = spark.createDataFrame([("r1", "e", "risky_transition", *[1.0] * 10), ("r2", "e", "benign_transition", *[0.0] * 10)], "record_id string, extension_id string, label string, " + ", ".join(f"{n} double" for n in names))
    got = {row.record_id: row for row in reviews.review_priority(rows, F.lit(False)).collect()}
    assert got["r1"].priority_score == 10 + 100 + 265 and got["r1"].is_priority and len(got["r1"].priority_reasons) == 11
    assert got["r2"].priority_score == 10 and got["r2"].priority_reasons == [vocab.PRIORITY_NONE] and not got["r2"].is_priority


def test_privacy(spark):
    body = json.dumps({"a": [{"risk_score": 1}], "text": "\"prediction\": 1", "access_token": 2})
    rows = spark.createDataFrame([("r", body, "mail me@example.org or C:\\x", "see /home/x and reviewer02")], "record_id string, packet string, t string, u string")
    assert [row.forbidden_key for row in privacy.forbidden_json_keys(rows, "packet").collect()] == ["risk_score"]
    assert [row.private_key for row in privacy.private_json_keys(rows, "packet").collect()] == ["access_token"]
    found = {(row.place, row.violation) for row in privacy.private_values(rows, ["t", "u"]).collect()}
    assert found == {("t", "email"), ("t", "windows_path"), ("u", "private_unix_path"), ("u", "private_id")}
    nested = rows.select(F.struct(F.array(F.struct(F.lit(1).alias("final_severity"))).alias("x")).alias("s"), F.lit(1).alias("my_secret"))
    assert privacy.forbidden_columns(nested) == ["s.x[].final_severity"] and privacy.private_columns(nested) == ["my_secret"]


def test_json_keys_are_told_from_values(spark):
    """Quotes in keys and values, blanks before the colon, an empty key; each string is read once, without a pattern for each key."""
    texts = [(r'{"a\"b" : "x\":y", "": ["a:", {"c\\": 1}], "a\"b":2}', [r'a\"b', "", r"c\\"])]
    rows = spark.createDataFrame([(text,) for text, _ in texts], "packet string")
    found = rows.select(privacy.json_keys(F.col("packet")).alias("keys"))
    assert found.first().keys == texts[0][1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 0
