"""Human review tables: validation, agreement, adjudication, queues, promotion, gold set.

A review is {review_id, reviewer_id, record_id, review_round, independent_label, confidence, rationale,
evidence_references, blind_review, review_timestamp, review_status}.
"""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope import vocab
from deltascope.functions import ids
from deltascope.functions.numbers import lookup, present, reasons
from deltascope.functions.versions import iso_time
from deltascope.operators import metrics
from deltascope.operators.curation import quality_tier
from deltascope.operators.ordering import positioned

C = F.col


def mapped_label(label: Column) -> Column:
    """Dataset label of a human label; an unknown one is not comparable."""
    return lookup(label, vocab.HUMAN_LABELS, vocab.NOT_COMPARABLE)


def review_id(reviewer: Column, record: Column, review_round: Column) -> Column:
    return ids.joined_id("HRV1", reviewer, record, review_round)


# -- validation -------------------------------------------------------------
def basic_errors(reviews: DataFrame) -> DataFrame:
    """Reviews with the errors of the short form check."""
    return reviews.withColumn(
        "errors",
        reasons(
            (~F.coalesce(C("independent_label").isin(list(vocab.HUMAN_LABELS)), F.lit(False)), "invalid independent_label"),
            (~F.coalesce(C("confidence").isin(vocab.REVIEW_CONFIDENCES), F.lit(False)), "invalid confidence"),
            (~F.coalesce(present(C("reviewer_id")), F.lit(False)), "reviewer_id is required for genuine review submissions"),
            (C("reviewer_id").isin(vocab.NON_HUMAN_REVIEWERS), "AI assistance cannot be represented as an independent reviewer"),
            (~F.coalesce(present(C("rationale")), F.lit(False)), "rationale is required"),
        ),
    )


def packet_fields(packets: DataFrame, packet: str = "packet") -> DataFrame:
    """All dotted object paths of packets given as JSON text: {record_id, field}.

    Lists are not entered, as a reference names object fields only. Depth is followed level by level; a
    level without objects ends it.
    """
    level = packets.select("record_id", F.lit("").alias("path"), F.try_parse_json(packet).alias("value"))
    found = None
    for _ in range(_deepest(packets, packet)):
        children = level.select(
            "record_id", "path", F.explode(F.from_json(F.to_json("value"), "map<string,variant>")).alias("key", "child")
        ).select("record_id", F.concat(C("path"), F.when(C("path") == "", "").otherwise("."), C("key")).alias("path"), C("child").alias("value"))
        part = children.select("record_id", C("path").alias("field"))
        found = part if found is None else found.unionByName(part)
        level = children.where(F.schema_of_variant("value").startswith("OBJECT"))
    return found


def _deepest(packets: DataFrame, packet: str) -> int:
    """Largest nesting depth of braces: an upper bound for the levels of `packet_fields`."""
    opened = F.regexp_replace(packet, r'"(?:[^"\\]|\\.)*+"|[^{}]', "")
    depth = F.aggregate(
        F.split(opened, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda state, mark: F.struct(
            (state["now"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)).alias("now"),
            F.greatest(state["top"], state["now"] + F.when(mark == "{", 1).otherwise(0)).alias("top"),
        ),
        lambda state: state["top"],
    )
    return packets.agg(F.max(depth)).first()[0] or 1


def strict_errors(reviews: DataFrame, fields: DataFrame, reviewer: str, review_round: str = "INITIAL_BLIND") -> DataFrame:
    """Reviews with the errors of the full form check; `fields` are the packet fields references must name.

    References and fields meet in one join on (record, field), so a packet or record of any size is spread.
    """
    references = reviews.select("review_id", "record_id", F.explode("evidence_references").alias("field")).distinct()
    unresolved = (
        references.join(fields.select("record_id", "field").distinct(), ["record_id", "field"], "left_anti")
        .select("review_id", "record_id").distinct().withColumn("_unresolved", F.lit(True))
    )
    known = fields.select("record_id").distinct().withColumn("_packet", F.lit(True))
    joined = reviews.join(unresolved, ["review_id", "record_id"], "left").join(known, "record_id", "left")
    expected = F.concat_ws("::", F.lit("HRV1"), F.lit(reviewer), C("record_id"), F.lit(review_round))
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    return joined.withColumn(
        "errors",
        reasons(
            (no(present(C("record_id"))), "record_id is required"),
            (C("_packet").isNull(), "submission record_id does not match packet record_id"),
            (no(C("reviewer_id") == reviewer), f"reviewer_id must equal {reviewer}"),
            (no(C("review_round") == review_round), f"review_round must equal {review_round}"),
            (no(C("independent_label").isin(list(vocab.HUMAN_LABELS))), "independent_label is invalid"),
            (no(C("confidence").isin(vocab.REVIEW_CONFIDENCES)), "confidence is invalid"),
            (no(F.trim("rationale") != ""), "rationale is required"),
            (no(F.size("evidence_references") > 0), "evidence_references must be a nonempty list"),
            (C("_unresolved").isNotNull(), "every evidence reference must resolve to a packet field"),
            (no(C("blind_review")), "blind_review must be true"),
            (no(C("review_status") == "SUBMITTED"), "review_status must equal SUBMITTED"),
            (iso_time(C("review_timestamp")).isNull(), "review_timestamp must be a valid ISO-8601 timestamp"),
            (no(C("review_id") == expected), "review_id must equal the preassigned governed review ID"),
        ),
    ).drop("_unresolved", "_packet")


def manual_review_errors(reviews: DataFrame) -> DataFrame:
    """Short manual reviews {record_id, reviewer_id, assigned_label, rationale, review_status} with errors."""
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    return reviews.withColumn(
        "errors",
        reasons(
            (no(present(C("record_id"))), "record_id is required"),
            (no(present(C("reviewer_id"))), "reviewer_id is required"),
            (no(C("assigned_label").isin(list(vocab.LABELS))), "assigned_label is invalid"),
            (no(C("review_status").isin(vocab.REVIEW_STATUSES)), "review_status is invalid"),
            (no(present(C("rationale"))), "rationale is required"),
        ),
    )


# -- agreement --------------------------------------------------------------
def case_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of either reviewer with where it is: {record_id, place}."""
    left = first.select("record_id").distinct().withColumn("_first", F.lit(True))
    right = second.select("record_id").distinct().withColumn("_second", F.lit(True))
    place = F.when(C("_second").isNull(), "missing_from_second").when(C("_first").isNull(), "extra_in_second").otherwise("common")
    return left.join(right, "record_id", "full_outer").select("record_id", place.alias("place"))


def compare_reviewers(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per common record with both labels, mapped labels, and whether they agree."""
    side = lambda reviews, name: reviews.select(
        "record_id",
        C("independent_label").alias(f"{name}_label"),
        mapped_label(C("independent_label")).alias(f"{name}_mapped"),
        C("confidence").alias(f"{name}_confidence"),
    )
    joined = side(first, "first").join(side(second, "second"), "record_id")
    comparable = (C("first_mapped") != vocab.NOT_COMPARABLE) & (C("second_mapped") != vocab.NOT_COMPARABLE)
    return joined.select(
        "*",
        comparable.alias("comparable"),
        F.when(comparable, C("first_mapped") == C("second_mapped")).alias("exact_match"),
        F.concat_ws("|", "first_confidence", "second_confidence").alias("confidence_pair"),
    )


def agreement_summary(compared: DataFrame) -> DataFrame:
    """One row: counts, percent of exact agreement, kappa."""
    counts = compared.agg(
        F.count("*").alias("total_common_cases"), F.count_if("comparable").alias("comparable_cases"),
        F.count_if("exact_match").alias("exact_agreements"), F.count_if(~C("exact_match")).alias("disagreements"),
    )
    kappa = metrics.cohens_kappa(compared.select(C("first_mapped").alias("left"), C("second_mapped").alias("right")))
    return counts.withColumns(
        {
            "percent_exact_agreement": F.try_divide(C("exact_agreements") * 100.0, C("comparable_cases")),
            "cohens_kappa": kappa.select("cohens_kappa").scalar(),
            "kappa_status": kappa.select("status").scalar(),
        }
    )


def label_matrix(compared: DataFrame) -> DataFrame:
    """Cross table over the fixed label list: one row per first label, one column per second label."""
    labels = list(vocab.HUMAN_LABELS.values())
    spark = compared.sparkSession
    counted = compared.where("comparable").groupBy("first_mapped").agg(
        *[F.count_if(C("second_mapped") == name).alias(name) for name in labels]
    )
    rows = spark.createDataFrame([(name,) for name in labels], "first_mapped string")
    return rows.join(counted, "first_mapped", "left").select("first_mapped", *[F.coalesce(name, F.lit(0)).alias(name) for name in labels])


def confidence_agreement(compared: DataFrame) -> DataFrame:
    return compared.where("comparable").groupBy("confidence_pair").agg(
        F.count("*").alias("case_count"), F.count_if("exact_match").alias("exact_agreement_count")
    ).withColumn("exact_agreement_rate", C("exact_agreement_count") / C("case_count"))


def concordance(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """Human label against project label per record; a review of an unknown record is an error."""
    joined = reviews.join(records.select("record_id", C("label").alias("project_label"), F.lit(True).alias("_known")), "record_id", "left")
    unknown = F.raise_error(F.concat(F.lit("record is absent from the dataset: "), C("record_id").cast("string"))).cast("boolean")
    mapped = mapped_label(C("independent_label"))
    comparable = F.coalesce(C("_known"), unknown) & (mapped != vocab.NOT_COMPARABLE) & C("project_label").isin(list(vocab.LABELS))
    return joined.withColumns({"mapped_label": mapped, "comparable": comparable}).withColumn(
        "exact_match", F.when(C("comparable"), C("mapped_label") == C("project_label"))
    ).drop("_known")


def concordance_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("record_count"), F.count_if("comparable").alias("comparable_record_count"),
        F.count_if("exact_match").alias("exact_match_count"),
    ).withColumn("exact_match_proportion", F.try_divide(C("exact_match_count"), C("comparable_record_count")))


def concordance_table(compared: DataFrame) -> DataFrame:
    """Comparable records by project label and human label: {project_label, human_label, records}."""
    return compared.where("comparable").groupBy("project_label", C("mapped_label").alias("human_label")).agg(F.count("*").alias("records"))


# -- adjudication -----------------------------------------------------------
def adjudication_status(reviews: DataFrame) -> DataFrame:
    """Per record: how many reviewers and labels, and what follows."""
    grouped = reviews.groupBy("record_id").agg(
        F.count("*").alias("reviews"),
        F.count_distinct("reviewer_id").alias("reviewers"),
        F.size(F.collect_set("independent_label")).alias("labels"),
    )
    return grouped.withColumn(
        "disagreement_status",
        F.when(C("reviewers") < 2, "single_review_only").when(C("labels") == 1, "agreement").otherwise("disagreement_pending_adjudication"),
    )


def inter_rater(statuses: DataFrame) -> DataFrame:
    """One row: percent agreement of double-reviewed records; null below two of them."""
    counts = statuses.agg(
        F.count_if(C("disagreement_status") == "agreement").alias("agreement_count"),
        F.count_if(C("disagreement_status") == "disagreement_pending_adjudication").alias("disagreement_count"),
    ).withColumn("double_reviewed_record_count", C("agreement_count") + C("disagreement_count"))
    enough = C("double_reviewed_record_count") >= 2
    return counts.withColumns(
        {
            "agreement_percentage": F.when(enough, F.try_divide(C("agreement_count"), C("double_reviewed_record_count"))),
            "status": F.when(enough, "INTER_RATER_AGREEMENT_AVAILABLE_EXACT_ONLY").otherwise("INTER_RATER_AGREEMENT_NOT_AVAILABLE"),
        }
    )


def deidentified_opinions(first: DataFrame, second: DataFrame, prefix: str = "reviewer-alias-v1") -> DataFrame:
    """Both opinions per record under aliases chosen by hash parity; reviewer ids are dropped."""
    opinion = lambda: F.struct(C("independent_label").alias("label"), "confidence", "rationale", "evidence_references")
    joined = first.select("record_id", opinion().alias("_a")).join(second.select("record_id", opinion().alias("_b")), "record_id")
    swapped = ids.alias_is_swapped(C("record_id").cast("string"), prefix)
    return joined.select(
        "record_id",
        F.when(swapped, C("_b")).otherwise(C("_a")).alias("reviewer_a"),
        F.when(swapped, C("_a")).otherwise(C("_b")).alias("reviewer_b"),
    )


def release_gate(expected: DataFrame, packets: DataFrame, submissions: DataFrame) -> DataFrame:
    """Errors per record that keep the second stage locked; no rows means it may be released.

    expected {record_id, packet_sha256}, packets {record_id, packet_sha256}, submissions {record_id, errors}.
    """
    joined = (
        expected.select("record_id", C("packet_sha256").alias("_wanted"))
        .join(packets.select("record_id", C("packet_sha256").alias("_found"), F.lit(True).alias("_has_packet")), "record_id", "full_outer")
        .join(submissions.select("record_id", "errors", F.lit(True).alias("_has_submission")), "record_id", "full_outer")
    )
    known = C("_wanted").isNotNull()
    problems = reasons(
        (~known & C("_has_packet").isNotNull(), "packet ID differs from the governed manifest"),
        (~known & C("_has_submission").isNotNull(), "submission ID differs from the governed manifest"),
        (known & C("_has_packet").isNull(), "packet is missing"),
        (known & C("_has_packet").isNotNull() & (C("_wanted") != C("_found")), "packet hash changed"),
        (known & C("_has_packet").isNotNull() & C("_has_submission").isNull(), "submission is missing"),
    )
    complaints = F.concat(problems, F.coalesce("errors", F.array().cast("array<string>")))
    return joined.select("record_id", F.explode(complaints).alias("error"))


def stage_comparison(first_stage: DataFrame, second_stage: DataFrame) -> DataFrame:
    """First and final adjudication label per record and whether it changed."""
    joined = first_stage.select("record_id", C("label").alias("first_label")).join(
        second_stage.select("record_id", C("label").alias("final_label")), "record_id"
    )
    return joined.withColumn("changed", C("first_label") != C("final_label"))


def promotion_assessment(final: DataFrame, records: DataFrame) -> DataFrame:
    """Whether an adjudicated record {record_id, final_label} may move to the adjudicated tier."""
    semantic = mapped_label(C("final_label"))
    joined = final.join(records.select("record_id", C("label_quality_tier").alias("current_tier")), "record_id")
    tier = quality_tier(semantic, F.lit("multi_analyst_manual_review"), F.lit("adjudicated"), F.lit(None).cast("string"))
    return joined.withColumns({"semantic_label": semantic, "assessed_tier": tier}).withColumn(
        "eligible", C("assessed_tier") == "MULTI_REVIEWER_ADJUDICATED"
    ).withColumn(
        "assessment", F.when(C("eligible"), "ELIGIBLE_FOR_PROMOTION").otherwise("NOT_ELIGIBLE_SEMANTIC_LABEL_UNCERTAIN")
    )


def agreed_assessment(compared: DataFrame, records: DataFrame) -> DataFrame:
    """Agreed records: agreement alone does not promote, only a qualifying tier counts."""
    agreed = compared.where("exact_match").select("record_id", C("first_label").alias("agreed_label"))
    joined = agreed.join(records.select("record_id", C("label_quality_tier").alias("current_tier")), "record_id")
    return joined.withColumn("qualifies", C("current_tier").isin(vocab.GOLD_TIERS)).withColumn(
        "assessment",
        F.when(C("qualifies"), "ALREADY_QUALIFYING_UNDER_EXISTING_TIER").otherwise(
            "FUTURE_GOVERNED_POLICY_CHANGE_OR_ADDITIONAL_ADJUDICATION_REQUIRED"
        ),
    )


def promotion_decisions(assessed: DataFrame, provenance: DataFrame, holdout: DataFrame, approved: DataFrame) -> DataFrame:
    """Decision per assessed record with target tier, readiness and reasons; ids are content-derived.

    `approved` holds the record ids an authority has approved.
    """
    joined = (
        assessed.join(provenance.select("record_id", "old_sha256", "new_sha256", "provenance_id"), "record_id", "left")
        .join(holdout.select("record_id").distinct().withColumn("_holdout", F.lit(True)), "record_id", "left")
        .join(approved.select("record_id").distinct().withColumn("_approved", F.lit(True)), "record_id", "left")
    )
    complete = F.coalesce(present(C("old_sha256")) & present(C("new_sha256")) & present(C("provenance_id")), F.lit(False))
    is_approved = C("_approved").isNotNull() & C("eligible")
    decided = joined.withColumns(
        {
            "provenance_complete": complete,
            "external_holdout_overlap": C("_holdout").isNotNull(),
            "promotion_decision": F.when(is_approved, "APPROVED").otherwise("NOT_QUALIFYING"),
            "target_quality_tier": F.when(is_approved, "MULTI_REVIEWER_ADJUDICATED").otherwise("UNCERTAIN"),
        }
    )
    why = reasons(
        (C("promotion_decision") != "APPROVED", "NOT_APPROVED_FOR_DEFINITIVE_QUALITY_PROMOTION"),
        (C("semantic_label") == "uncertain", "UNCERTAIN_SEMANTIC_LABEL_EXCLUDED"),
        (~C("provenance_complete"), "PROVENANCE_INCOMPLETE"),
        (C("external_holdout_overlap"), "EXTERNAL_HOLDOUT_FORBIDDEN"),
    )
    basis = F.struct("record_id", "promotion_decision", "target_quality_tier", "semantic_label")
    return decided.drop("_holdout", "_approved").withColumns(
        {
            "non_ready_reasons": why,
            "decision_id": F.concat(F.lit("QPD1::"), ids.canonical_hash(basis)),
        }
    ).withColumn(
        "gold_set_ready", (F.size("non_ready_reasons") == 0) & C("semantic_label").isin(vocab.SUPERVISED_LABELS)
    )


def lineage_failures(decisions: DataFrame, view: DataFrame, frozen: DataFrame) -> DataFrame:
    """Records whose decision, derived view and frozen row do not agree by id, tier and canonical hash.

    decisions {record_id, target_quality_tier, frozen_sha256}, view {record_id, derived_quality_tier,
    frozen_sha256}, frozen = the rows themselves, hashed here.
    """
    hashed = frozen.select("record_id", ids.canonical_hash(F.struct(*sorted(frozen.columns))).alias("_frozen"))
    joined = (
        decisions.select("record_id", "target_quality_tier", C("frozen_sha256").alias("_decided"))
        .join(view.select("record_id", "derived_quality_tier", C("frozen_sha256").alias("_viewed")), "record_id", "full_outer")
        .join(hashed, "record_id", "left")
    )
    failed = reasons(
        (C("target_quality_tier").isNull(), "decision missing"),
        (C("derived_quality_tier").isNull(), "derived view missing"),
        (C("_frozen").isNull(), "frozen source row missing"),
        (C("_viewed") != C("_frozen"), "frozen row hash differs"),
        (C("_decided") != C("_viewed"), "promotion frozen-row hash differs"),
        (C("target_quality_tier") != C("derived_quality_tier"), "derived tier differs"),
    )
    return joined.select("record_id", F.explode(failed).alias("failure"))


# -- eligibility and gold set -----------------------------------------------
def reviewed_eligibility(records: DataFrame, statuses: DataFrame, holdout: DataFrame) -> DataFrame:
    """Training eligibility after review, with the reasons against it."""
    disputed = statuses.where(C("disagreement_status") == "disagreement_pending_adjudication").select("record_id").withColumn("_disputed", F.lit(True))
    held = holdout.select("record_id").distinct().withColumn("_holdout", F.lit(True))
    joined = records.join(disputed, "record_id", "left").join(held, "record_id", "left")
    why = reasons(
        (C("label").isin("uncertain", "excluded"), F.concat(C("label"), F.lit(" is not supervised-training eligible"))),
        (C("_disputed").isNotNull(), "unresolved reviewer disagreement"),
        (C("label_quality_tier") == "UNCERTAIN", "uncertain label-quality tier"),
        (C("_holdout").isNotNull(), "external holdout excluded from supervised training"),
    )
    return joined.select(
        "record_id", "label",
        (F.coalesce(C("eligible_for_supervised_training"), F.lit(False)) & (F.size(why) == 0)).alias("eligible"),
        why.alias("eligibility_reasons"),
    )


def evidence_tier(source: Column, label: Column) -> Column:
    return F.when(source == "repository_documented_change", "TIER_4").when(label == "uncertain", "TIER_6").otherwise("TIER_5")


def gold_set(records: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """Records that qualify: a strong tier, a decided label, both hashes, and no holdout overlap."""
    qualified = records.where(
        C("label_quality_tier").isin(vocab.GOLD_TIERS)
        & ~C("label").isin("uncertain", "excluded")
        & F.coalesce(present(C("old_sha256")) & present(C("new_sha256")), F.lit(False))
    )
    if holdout is not None:
        qualified = qualified.join(holdout.select("record_id").distinct(), "record_id", "left_anti")
    return qualified.select(
        "record_id", "extension_id", "label", C("label_quality_tier").alias("label_source"),
        evidence_tier(C("label_source"), C("label")).alias("evidence_tier"),
        F.when(F.coalesce(C("is_controlled"), F.lit(False)), "controlled").otherwise("real").alias("real_or_controlled"),
    )


def gold_set_quality(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count("*").alias("total_gold_records"),
        F.count_if(C("real_or_controlled") == "real").alias("real_gold_records"),
        F.count_if(C("real_or_controlled") == "controlled").alias("controlled_gold_records"),
        F.count_distinct("extension_id").alias("unique_extensions"),
        *[F.count_if(C("label") == name).alias(f"label_{name}") for name in vocab.LABELS],
    )


# -- queues -----------------------------------------------------------------
# Second-review weights of the first stage; later stages give uncertain 90 and malicious 120
FIRST_STAGE_WEIGHTS = {"risky_transition": 100, "uncertain": 80}
LATER_STAGE_WEIGHTS = {"malicious_transition": 120, "risky_transition": 100, "uncertain": 90}


def second_review_queue(records: DataFrame, weights: dict[str, int] | None = None, new_note: str = "new record") -> DataFrame:
    """Records by second-review priority, with their rank."""
    weights = LATER_STAGE_WEIGHTS if weights is None else weights
    score = (
        lookup(C("label"), weights, 0)
        + F.when(F.array_contains("notes", new_note), 20).otherwise(0)
        + F.when(C("label_quality_tier") == "SINGLE_REVIEWER_PROVISIONAL", 10).otherwise(0)
    )
    queued = records.select("record_id", "extension_id", "label", "label_quality_tier", score.alias("priority_score"))
    return positioned(queued, [-C("priority_score"), C("record_id")], name="rank")


def review_priority(features: DataFrame, holdout: Column) -> DataFrame:
    """Blind-review priority of feature rows with its reasons, and whether it is a priority review."""
    triggers = [(C("label") == label, weight, why) for label, (weight, why) in vocab.PRIORITY_LABELS.items()]
    triggers.append((holdout, *vocab.PRIORITY_HOLDOUT))
    triggers += [(F.coalesce(C(name).cast("double"), F.lit(0.0)) > 0, weight, why) for name, weight, why in vocab.PRIORITY_FEATURES]
    fired = F.array_compact(
        F.array(*[F.when(condition, F.struct(F.lit(weight).alias("weight"), F.lit(why).alias("reason"))) for condition, weight, why in triggers])
    )
    scored = features.withColumns({"external_holdout": F.coalesce(holdout, F.lit(False)), "_fired": fired}).withColumns(
        {
            "priority_score": F.aggregate("_fired", F.lit(vocab.PRIORITY_BASE), lambda total, item: total + item["weight"]),
            "priority_reasons": F.when(F.size("_fired") > 0, F.transform("_fired", lambda item: item["reason"])).otherwise(
                F.array(F.lit(vocab.PRIORITY_NONE))
            ),
        }
    ).drop("_fired")
    return scored.withColumn(
        "is_priority",
        C("label").isin(list(vocab.PRIORITY_LABELS)) | C("external_holdout") | (C("priority_score") >= vocab.PRIORITY_THRESHOLD),
    )


def priority_queue(prioritised: DataFrame) -> DataFrame:
    """Priority reviews in rank order columns: {rank, record_id, priority_score, priority_reasons}."""
    wanted = prioritised.where("is_priority").select("record_id", "extension_id", "priority_score", "priority_reasons")
    return positioned(wanted, [-C("priority_score"), C("record_id")], name="rank")


def unresolved_packets(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Uncertain records with their drift evidence and the outcomes a reviewer may choose."""
    outcomes = [name for name in vocab.LABELS if name not in ("controlled_malicious_transition", "needs_review")]
    return (
        records.where(C("label") == "uncertain")
        .join(evidence, "record_id", "left")
        .withColumn("allowed_outcomes", F.array(*[F.lit(name) for name in outcomes]))
        .withColumn("eligible_for_supervised_training", F.lit(False))
    )


def review_summary(prioritised: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: records, priorities, labels, holdout, genuine reviews per round."""
    label = lambda name: F.count_if(C("label") == name)
    rounds = reviews.where(present(C("reviewer_id"))).agg(
        F.count_if(C("review_round") == "INITIAL_BLIND").alias("a"), F.count_if(C("review_round") == "SECOND_BLIND").alias("b")
    )
    return prioritised.agg(
        F.count("*").alias("total_records"), F.count_if("is_priority").alias("review_priority_records"),
        label("benign_transition").alias("benign_review_candidates"), label("risky_transition").alias("risky_review_candidates"),
        label("malicious_transition").alias("malicious_candidates"), label("uncertain").alias("uncertain_records"),
        F.count_if("external_holdout").alias("external_holdout_candidates"),
    ).withColumns({"first_reviews": rounds.select("a").scalar(), "second_reviews": rounds.select("b").scalar()})


# -- blind packets ----------------------------------------------------------
# What a blind packet shows
PACKET_FIELDS = [
    "record_id", "extension_id", "extension_name", "old_version", "new_version", "old_timestamp", "new_timestamp",
    "provenance_id", "added_permissions", "removed_permissions", "added_hosts", "removed_hosts", "background_added",
    "content_scripts_changed", "csp_changed", "externally_connectable_changed", "added_api_names", "external_sample",
    "new_external_count", "decoded_endpoint_count", "added_function_count", "added_listener_count",
    "added_obfuscation_count", "flows", "evidence_tier",
]


def blind_packets(evidence: DataFrame) -> DataFrame:
    """What a blind reviewer may see: an allow-list, so scores, labels and model output cannot slip through."""
    shown = [name for name in PACKET_FIELDS if name in evidence.columns]
    return evidence.select(C("record_id"), F.to_json(F.struct(*shown)).alias("packet"), F.lit(True).alias("blind_review"))
