"""Audits and reports over pair and feature tables: duplicates, leakage, splits, readiness, distributions."""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope import vocab
from deltascope.functions.numbers import fixed_array, present, ratio, reasons

C = F.col
_protected = lambda: C("split").isin(vocab.SPLITS)


# -- duplicates -------------------------------------------------------------
def package_sides(records: DataFrame) -> DataFrame:
    """Two rows per record: the hash, version and side of each package that has a hash."""
    side = lambda name: F.struct(
        F.lit(name).alias("side"), C(f"{name}_sha256").alias("sha256"), C(f"{name}_version").alias("version")
    )
    sides = records.select("pair_id", "extension_id", F.inline(F.array(side("old"), side("new"))))
    return sides.where(present(C("sha256")))


def repeated_hashes(records: DataFrame) -> DataFrame:
    """One row per package hash used more than once, and whether it is the expected reuse of a chain.

    Expected: exactly one old and one new use, in one extension, where the version that is old in one
    pair is the version that is new in the other.
    """
    grouped = package_sides(records).groupBy("sha256").agg(
        F.count("*").alias("uses"),
        F.count_if(C("side") == "old").alias("old_uses"),
        F.min("extension_id").alias("_low"),
        F.max("extension_id").alias("_high"),
        F.min(F.when(C("side") == "old", C("version"))).alias("_old_version"),
        F.min(F.when(C("side") == "new", C("version"))).alias("_new_version"),
    )
    adjacent = (
        (C("uses") == 2) & (C("old_uses") == 1) & (C("_low") == C("_high")) & (C("_old_version") == C("_new_version"))
    )
    return grouped.where(C("uses") > 1).select(
        "sha256", "uses", F.coalesce(adjacent, F.lit(False)).alias("adjacent_reuse")
    )


def repeated_hash_members(records: DataFrame) -> DataFrame:
    """Every use of every repeated hash, one row each, however many uses a hash has."""
    repeated = repeated_hashes(records)
    members = package_sides(records).join(repeated, "sha256")  # a frequent hash is one row on that side; adaptive execution splits the other
    return members.select("sha256", "pair_id", "side", "adjacent_reuse")


def repeated_ids(records: DataFrame) -> DataFrame:
    return records.where(present(C("pair_id"))).groupBy("pair_id").agg(F.count("*").alias("copies")).where("copies > 1")


def repeated_transitions(records: DataFrame) -> DataFrame:
    return (
        records.groupBy("extension_id", "old_version", "new_version")
        .agg(F.count("*").alias("records"), F.min("pair_id").alias("first_pair_id"), F.max("pair_id").alias("last_pair_id"))
        .where("records > 1")
    )


def duplicate_report(records: DataFrame) -> DataFrame:
    """One row: counts of each kind of duplicate and whether the audit passes."""
    hashes = repeated_hashes(records).agg(
        F.count_if(~C("adjacent_reuse")).alias("duplicate_package_hashes"),
        F.count_if(C("adjacent_reuse")).alias("adjacent_version_reuse"),
    )
    return hashes.select(
        repeated_ids(records).agg(F.count("*")).scalar().alias("duplicate_record_ids"),
        repeated_transitions(records).agg(F.count("*")).scalar().alias("duplicate_pairs"),
        "duplicate_package_hashes",
        "adjacent_version_reuse",
    ).withColumn(
        "passed",
        (C("duplicate_record_ids") + C("duplicate_pairs") + C("duplicate_package_hashes")) == 0,
    )


# -- split leakage ----------------------------------------------------------
def _in_several_splits(rows: DataFrame, keys: list[str], kind: str, key: Column) -> DataFrame:
    """Keys seen in more than one protected split; a split set has at most three members."""
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return grouped.where(F.size("splits") > 1).select(F.lit(kind).alias("type"), key.cast("string").alias("key"), "splits")


def split_leakage(records: DataFrame) -> DataFrame:
    """Violations: an extension, a package hash or a mutation family in more than one of train, validation, test."""
    rows = records.where(_protected())
    hashes = rows.select("split", F.explode(F.array("old_sha256", "new_sha256")).alias("sha256")).where(present(C("sha256")))
    found = _in_several_splits(rows.where(present(C("extension_id"))), ["extension_id"], "extension_group", C("extension_id"))
    found = found.unionByName(_in_several_splits(hashes, ["sha256"], "package_hash", C("sha256")))
    if "controlled_mutation_type" in records.columns:
        family = rows.where(present(C("controlled_mutation_type")))
        found = found.unionByName(
            _in_several_splits(
                family, ["extension_id", "controlled_mutation_type"], "controlled_mutation_family",
                F.concat_ws(":", "extension_id", "controlled_mutation_type"),
            )
        )
    return found


def group_split_audit(eligible: DataFrame, provenance: DataFrame) -> DataFrame:
    """Violations among eligible rows joined to provenance {record_id, old_sha256, new_sha256}:
    extension overlap, hash overlap, and repeated (old hash, new hash) transitions."""
    extension = _in_several_splits(eligible, ["extension_id"], "extension_overlap", C("extension_id"))
    joined = eligible.select("record_id", "split").join(provenance.select("record_id", "old_sha256", "new_sha256"), "record_id")
    hashes = joined.select("split", F.explode(F.array("old_sha256", "new_sha256")).alias("sha256")).where(present(C("sha256")))
    overlap = _in_several_splits(hashes, ["sha256"], "package_hash_overlap", C("sha256"))
    repeated = (
        joined.where(present(C("old_sha256")) & present(C("new_sha256")))
        .groupBy("old_sha256", "new_sha256")
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"))
        .where("n > 1")
        .select(F.lit("duplicate_transition_pairs").alias("type"), F.concat_ws("->", "old_sha256", "new_sha256").alias("key"), "splits")
    )
    return extension.unionByName(overlap).unionByName(repeated)


def split_quality(records: DataFrame, minimum_test_records: int = 5) -> DataFrame:
    """One row: counts per protected split, extension statistics, block reasons and warnings."""
    eligible = F.coalesce(C("eligible_for_supervised_training"), F.lit(False))
    controlled = F.coalesce(present(C("controlled_mutation_type")), F.lit(False)) if "controlled_mutation_type" in records.columns else F.lit(False)
    per_split = []
    for name in vocab.SPLITS:
        here = C("split") == name
        per_split += [
            F.count_if(here).alias(f"{name}_records"),
            F.count_distinct(F.when(here, C("extension_id"))).alias(f"{name}_extensions"),
            F.size(F.collect_set(F.when(here & eligible, C("label")))).alias(f"{name}_eligible_labels"),
            F.count_if(here & ~controlled).alias(f"{name}_real"),
            F.count_if(here & controlled).alias(f"{name}_controlled"),
        ]
    counted = records.agg(*per_split)
    sizes = records.groupBy("extension_id").agg(F.count("*").alias("pairs")).agg(
        F.count("*").alias("unique_extensions"), F.min("pairs").alias("min_pairs"),
        F.max("pairs").alias("max_pairs"), F.median("pairs").alias("median_pairs"),
    )
    leaks = split_leakage(records).agg(F.count("*"))
    numbered = counted.withColumn("leakage_violations", leaks.scalar())
    for name in ("unique_extensions", "min_pairs", "max_pairs", "median_pairs"):
        numbered = numbered.withColumn(name, F.coalesce(sizes.select(name).scalar(), F.lit(0)))
    return numbered.withColumns(
        {
            "block_reasons": reasons(
                (C("test_records") < minimum_test_records, "test split contains fewer than five records"),
                (C("test_extensions") < 2, "test split contains fewer than two extension identities"),
                (C("leakage_violations") > 0, "protected split leakage detected"),
            ),
            "warnings": reasons((C("test_eligible_labels") < 2, "test split has a single eligible supervised label class")),
        }
    )


def split_label_counts(records: DataFrame) -> DataFrame:
    """Records and eligible records per protected split and label."""
    return records.where(_protected()).groupBy("split", "label").agg(
        F.count("*").alias("records"), F.count_if(C("eligible_for_supervised_training")).alias("eligible")
    )


# -- feature leakage --------------------------------------------------------
def feature_name_leaks(names: list[str], terms: list[str] | None = None) -> list[tuple[str, str]]:
    """(feature, term) for every forbidden word in a feature name."""
    terms = vocab.FEATURE_NAME_TERMS if terms is None else terms
    return [(name, term) for name in names for term in terms if term in name.lower()]


def feature_value_leaks(rows: DataFrame, names: list[str], key: str = "record_id") -> DataFrame:
    """Text features that mention a label-like word: {record_id, feature, term}."""
    kinds = dict(rows.dtypes)
    texts = [name for name in names if kinds[name] == "string"]
    if not texts:
        return rows.select(C(key), F.lit("").alias("feature"), F.lit("").alias("term")).limit(0)
    long = rows.unpivot([key], texts, "feature", "value")
    terms = F.filter(fixed_array(vocab.FEATURE_TEXT_TERMS), lambda term: F.lower("value").contains(term))
    return long.select(key, "feature", F.explode(terms).alias("term"))


def feature_group_leaks(rows: DataFrame) -> DataFrame:
    """Extensions in more than one split, not counting the controlled holdout or unsplit rows."""
    counted = rows.where(present(C("split")) & (C("split") != vocab.HOLDOUT_SPLIT) & present(C("extension_id")))
    grouped = counted.groupBy("extension_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return grouped.where(F.size("splits") > 1)


def review_metadata_leaks(columns: list[str], blocked: list[str]) -> list[str]:
    """Feature columns that carry review metadata, by exact name or by a word in the name."""
    words = sorted(set(blocked) | {"review", "adjudication", "gold", "evidence_tier"})
    return sorted(
        name for name in columns if name not in vocab.METADATA_COLUMNS and (name in blocked or any(word in name.lower() for word in words))
    )


# -- readiness --------------------------------------------------------------
def readiness(rows: DataFrame) -> DataFrame:
    """One row: size, classes, splits, controlled share, duplicates, provenance, training permission and reasons."""
    text = lambda name: F.coalesce(C(name).cast("string"), F.lit(""))
    controlled = (text("source_type") == "controlled_sample") | (text("split") == vocab.HOLDOUT_SPLIT)
    complete = present(C("provenance_id")) & present(C("source_type")) & present(C("extension_id")) & present(C("record_id"))
    flags = [name for name in rows.columns if name.endswith("_available")]
    missing = [
        F.count_if(~F.coalesce(C(name).cast("string").isin("1", "1.0"), F.lit(False))).alias(f"missing_{name.removesuffix('_available')}")
        for name in flags
    ]
    facts = rows.agg(
        F.count("*").alias("record_count"),
        F.count_distinct(F.when(present(C("extension_id")), C("extension_id"))).alias("unique_extension_count"),
        F.size(F.collect_set(F.when(present(C("label")), C("label")))).alias("class_count"),
        F.count_if(C("split") == "train").alias("train_records"),
        F.count_if(C("split") == "test").alias("test_records"),
        F.count_if(controlled).alias("controlled_record_count"),
        F.count_if(F.coalesce(complete, F.lit(False))).alias("provenance_complete_count"),
        *missing,
    )
    repeats = rows.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*"))
    return readiness_verdict(
        facts.withColumn("real_record_count", C("record_count") - C("controlled_record_count")).withColumn(
            "duplicate_record_ids", repeats.scalar()
        )
    )


def readiness_verdict(facts: DataFrame) -> DataFrame:
    permitted = (
        (C("record_count") >= 20) & (C("train_records") >= 10) & (C("test_records") >= 5) & (C("class_count") >= 2)
        & (C("real_record_count") > 0) & (C("duplicate_record_ids") == 0)
    )
    return facts.withColumns(
        {
            "ml_training_permitted": permitted,
            "ml_block_reasons": reasons(
                (C("record_count") < 20, "fewer than 20 records"),
                ((C("train_records") == 0) | (C("test_records") == 0), "no train/test split assignments"),
                (C("real_record_count") == 0, "all records are controlled/synthetic"),
                (C("class_count") < 2, "fewer than two evaluable classes"),
                (C("duplicate_record_ids") > 0, "duplicate record IDs present"),
            ),
        }
    )


# Readiness gates as (condition that fails, message, level) over one row of facts
GATES = {
    "pilot": [
        ("real_record_count < 20", "real record count is below the minimum pilot supervised evaluation threshold", "block"),
        ("eligible_count < 20", "fewer than 20 eligible supervised-training real records", "block"),
        ("test_records < 5", "test split contains fewer than five records", "block"),
        ("test_extensions < 2", "test split contains fewer than two extension identities", "block"),
        ("test_eligible_labels = 0", "test split has no eligible supervised labels", "block"),
        ("test_eligible_labels = 1", "test split has a single eligible supervised label class", "warn"),
        ("provenance_complete_count <> record_count", "provenance is incomplete for one or more accepted records", "block"),
        ("not duplicates_passed", "duplicate audit failed", "block"),
        ("not leakage_passed", "protected leakage audit failed", "block"),
        ("failed_records > 0", "feature extraction failed for one or more records", "block"),
        ("uncertain_count > 0 and eligible_uncertain_count > 0", "uncertain records are marked eligible for supervised training", "block"),
        ("provisional_count > 0", "single-reviewer provisional labels remain and must be treated as a limitation", "warn"),
    ],
    "supervised": [
        ("eligible_count < 20", "fewer than 20 eligible supervised records", "block"),
        ("eligible_extensions < 6", "fewer than 6 eligible extension groups", "block"),
        ("train_classes < 2", "train split lacks both binary target classes", "block"),
        ("validation_classes < 2", "validation split lacks both binary target classes", "block"),
        ("test_classes < 2", "test split lacks both binary target classes", "block"),
    ],
    "groups": [
        ("extension_overlap > 0", "an extension is in more than one split", "block"),
        ("package_hash_overlap > 0", "a package hash is in more than one split", "block"),
        ("duplicate_transition_pairs > 0", "a transition occurs more than once", "block"),
    ],
    "last_stage": [
        ("real_gold_count = 0", "no defensible real Gold Set exists", "block"),
        ("later_reviews = 0", "no genuine second-review/adjudication records exist", "block"),
        ("holdout_count = 0 or holdout_provisional_count > 0", "external holdout labels remain provisional", "block"),
        ("provisional_count > 0", "single-reviewer provisional labels still dominate", "block"),
        ("confirmed_malicious_count = 0", "confirmed malicious-transition ground truth count is 0", "block"),
    ],
    "replication": [
        ("not validation_passed", "dataset validation failed", "block"),
        ("not duplicates_passed", "duplicate audit failed", "block"),
        ("not leakage_passed", "group leakage audit failed", "block"),
        ("real_record_count < 50", "dataset did not reach preferred 50+ real-pair target", "warn"),
        ("unique_extension_count < 15", "dataset did not reach preferred 15+ unique-extension target", "warn"),
        ("eligible_label_count < 2", "eligible supervised labels do not contain both binary classes", "block"),
        ("provisional_count > 0", "single-reviewer provisional labels remain", "warn"),
    ],
}


def maturation_gate(records: int, extensions: int) -> list[tuple[str, str, str]]:
    """Gate of a corpus stage with its planning targets."""
    return [
        ("not validation_passed", "dataset validation failed", "block"),
        ("not duplicates_passed", "duplicate audit failed", "block"),
        ("not leakage_passed", "protected split leakage detected", "block"),
        (f"real_record_count < {records}", f"planning target of {records}+ real records was not reached", "warn"),
        (f"unique_extension_count < {extensions}", f"planning target of {extensions}+ unique extensions was not reached", "warn"),
        ("provisional_count > 0", "single-reviewer provisional labels still dominate", "warn"),
        ("uncertain_tier_count > 0", "uncertain records remain in review queue and are training-ineligible", "warn"),
        ("missing_analyzer_count > 0", "some optional analyzer outputs are unavailable and tracked explicitly", "warn"),
    ]


GATES["maturation_60"] = maturation_gate(60, 18)
GATES["maturation_75"] = maturation_gate(75, 20)


def gate(facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Apply a gate to rows of facts: block reasons, warnings, and whether it is passed."""
    level = lambda wanted: [(F.expr(condition), message) for condition, message, kind in rules if kind == wanted]
    none = F.array().cast("array<string>")
    blocks, warnings = level("block"), level("warn")
    return facts.withColumns(
        {
            "block_reasons": reasons(*blocks) if blocks else none,
            "warnings": reasons(*warnings) if warnings else none,
        }
    ).withColumn("ready", F.size("block_reasons") == 0)


def corpus_facts(records: DataFrame) -> DataFrame:
    """The one-row facts the corpus gates read, from a pair table in one pass."""
    eligible = F.coalesce(C("eligible_for_supervised_training"), F.lit(False))
    classes = lambda name: F.size(
        F.collect_set(F.when(eligible & (C("split") == name), C("label").isin([k for k, v in vocab.BINARY_LABELS.items() if v])))
    )
    return records.agg(
        F.count("*").alias("record_count"),
        F.count_if(~F.coalesce(C("is_controlled"), F.lit(False))).alias("real_record_count"),
        F.count_if(eligible).alias("eligible_count"),
        F.count_distinct("extension_id").alias("unique_extension_count"),
        F.count_distinct(F.when(eligible, C("extension_id"))).alias("eligible_extensions"),
        F.count_if(C("split") == "test").alias("test_records"),
        F.count_distinct(F.when(C("split") == "test", C("extension_id"))).alias("test_extensions"),
        F.size(F.collect_set(F.when(eligible & (C("split") == "test"), C("label")))).alias("test_eligible_labels"),
        F.size(F.collect_set(F.when(eligible, C("label")))).alias("eligible_label_count"),
        *[classes(name).alias(f"{name}_classes") for name in vocab.SPLITS],
        F.count_if(C("label") == "uncertain").alias("uncertain_count"),
        F.count_if((C("label") == "uncertain") & eligible).alias("eligible_uncertain_count"),
        F.count_if(C("label_quality_tier") == "SINGLE_REVIEWER_PROVISIONAL").alias("provisional_count"),
        F.count_if(C("label_quality_tier") == "UNCERTAIN").alias("uncertain_tier_count"),
    )


# -- before training, and after the last review stage ------------------------
def supervised_gate(eligible: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row: whether eligible rows {record_id, extension_id, label, split} may be trained on, and why not.

    Too few records or extensions, a split without both classes, an extension in several splits and, with
    `provenance` {record_id, old_sha256, new_sha256}, package hashes in several splits and transitions that
    occur twice. Rows without a split count as records only.
    """
    positive = C("label").isin([name for name, value in vocab.BINARY_LABELS.items() if value])
    classes = lambda name: F.size(F.collect_set(F.when(C("split") == name, positive)))
    counted = eligible.agg(
        F.count("*").alias("eligible_count"), F.count_distinct("extension_id").alias("eligible_extensions"),
        *[classes(name).alias(f"{name}_classes") for name in vocab.SPLITS],
    )
    if provenance is None:
        found = _in_several_splits(eligible, ["extension_id"], "extension_overlap", C("extension_id"))
    else:
        found = group_split_audit(eligible, provenance)
    kinds = ("extension_overlap", "package_hash_overlap", "duplicate_transition_pairs")
    violations = found.agg(F.struct(*[F.count_if(C("type") == kind).alias(kind) for kind in kinds]).alias("violations"))
    facts = counted.withColumn("violations", violations.scalar()).select("*", "violations.*").drop("violations")
    return gate(facts, GATES["supervised"] + GATES["groups"]).drop("warnings")


# Checks of the last review stage over its facts. Four are positions, not measurements: labels stay
# provisional whatever their number, and neither scores nor tuning ever touch labels or holdout.
LAST_STAGE_CHECKS = [
    ("defensible_real_gold_set_exists", "real_gold_count > 0"),
    ("external_holdout_ground_truth_sufficient", "false"),
    ("enough_held_out_extension_identities", "holdout_extensions >= 3"),
    ("labels_independent_of_scores", "true"),
    ("provisional_label_dependence_acceptable", "false"),
    ("label_diversity_sufficient", "risky_candidates + malicious_candidates >= 10"),
    ("holdout_untouched_by_tuning", "true"),
    ("leakage_audit_clean", "names_passed and duplicates_passed and leakage_passed"),
]


def last_stage_facts(records: DataFrame, gold: DataFrame, holdout: DataFrame, reviews: DataFrame) -> DataFrame:
    """The one-row facts of the last-stage gate.

    `records` {record_id, extension_id, label, label_quality_tier}, `gold` {real_or_controlled}, `holdout`
    {record_id}, `reviews` {reviewer_id, review_round}. Empty tables give zeros.
    """
    tier, label = C("label_quality_tier"), C("label")
    held = records.join(holdout.select("record_id").distinct(), "record_id", "left_semi")
    side = lambda frame, **values: frame.agg(F.struct(*[value.alias(name) for name, value in values.items()]).alias("side")).scalar()
    kind = C("real_or_controlled")
    genuine = F.coalesce(present(C("reviewer_id")), F.lit(False))
    return (
        records.agg(
            F.count("*").alias("record_count"),
            F.count_if(label == "risky_transition").alias("risky_candidates"),
            F.count_if(label == "malicious_transition").alias("malicious_candidates"),
            F.count_if(tier == "SINGLE_REVIEWER_PROVISIONAL").alias("provisional_count"),
            F.count_if((label == "malicious_transition") & tier.isin(vocab.GOLD_TIERS)).alias("confirmed_malicious_count"),
        )
        .withColumns({
            "gold": side(gold, real_gold_count=F.count_if(kind == "real"), controlled_gold_count=F.count_if(kind == "controlled")),
            "held": side(
                held, holdout_count=F.count("*"), holdout_extensions=F.count_distinct("extension_id"),
                holdout_provisional_count=F.count_if(~F.coalesce(tier.isin(vocab.GOLD_TIERS), F.lit(False))),
            ),
            "read": side(reviews, later_reviews=F.count_if(genuine & (C("review_round") != "INITIAL_BLIND"))),
        })
        .select("*", "gold.*", "held.*", "read.*")
        .drop("gold", "held", "read")
    )


def last_stage_readiness(facts: DataFrame) -> DataFrame:
    """Facts with every check, `block_reasons`, and `ready`: whether all checks hold.

    Besides `last_stage_facts` it reads names_passed, duplicates_passed and leakage_passed; a null one fails.
    """
    checked = facts.withColumns({name: F.coalesce(F.expr(check), F.lit(False)) for name, check in LAST_STAGE_CHECKS})
    everything = F.forall(F.array(*[name for name, _ in LAST_STAGE_CHECKS]), lambda passed: passed)
    return gate(checked, GATES["last_stage"]).withColumn("ready", everything).drop("warnings")


# -- distributions ----------------------------------------------------------
def distributions(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts of many single dimensions in one pass: {dimension, value, records, extensions}."""
    filled = rows.select(
        "extension_id", *[F.coalesce(F.nullif(C(name).cast("string"), F.lit("")), F.lit("unknown")).alias(name) for name in dimensions]
    )
    grouped = filled.groupingSets([[name] for name in dimensions], *dimensions).agg(
        *[F.grouping(name).alias(f"_{name}") for name in dimensions],
        F.count("*").alias("records"), F.count_distinct("extension_id").alias("extensions"),
    )
    chosen = F.coalesce(*[F.when(C(f"_{name}") == 0, F.struct(F.lit(name).alias("dimension"), C(name).alias("value"))) for name in dimensions])
    return grouped.select(chosen.alias("at"), "records", "extensions").select("at.*", "records", "extensions")


def intake_summary(curated: DataFrame) -> DataFrame:
    """One row of totals for curated records of all stages."""
    stage = lambda name: C("stage") == name
    return curated.agg(
        F.count("*").alias("imported"),
        F.count_if(stage("ACCEPTED")).alias("accepted"),
        F.count_if(stage("QUARANTINED")).alias("quarantined"),
        F.count_if(stage("EXCLUDED")).alias("excluded"),
        F.count_if(~C("is_controlled")).alias("real_record_count"),
        F.count_if(C("is_controlled")).alias("controlled_record_count"),
        F.count_distinct(F.when(stage("ACCEPTED"), C("extension_id"))).alias("unique_extension_count"),
        F.count_if(C("eligible_for_supervised_training")).alias("eligible_supervised_training_count"),
    )


def label_quality(records: DataFrame) -> DataFrame:
    """One row: records per tier, double reviewed, eligible, uncertain but eligible."""
    eligible = F.coalesce(C("eligible_for_supervised_training"), F.lit(False))
    return records.agg(
        *[F.count_if(C("label_quality_tier") == name).alias(name.lower()) for name in vocab.QUALITY_TIERS],
        F.count_if(C("label_quality_tier") == "MULTI_REVIEWER_ADJUDICATED").alias("double_reviewed_count"),
        F.count_if(eligible).alias("eligible_supervised_training_count"),
        F.count_if(eligible & (C("label") == "uncertain")).alias("uncertain_training_eligible_count"),
    )


def diversity(records: DataFrame) -> DataFrame:
    """Per category: distinct extensions, transitions, and records per label."""
    category = F.coalesce(F.nullif(C("functional_category"), F.lit("")), F.lit("unknown"))
    return records.groupBy(category.alias("category")).agg(
        F.count_distinct("extension_id").alias("extensions"),
        F.count("*").alias("transitions"),
        *[F.count_if(C("label") == name).alias(name) for name in vocab.LABELS],
    )


def temporal_coverage(records: DataFrame) -> DataFrame:
    """Dated transitions per year of the new version."""
    dated = records.where(present(C("old_timestamp")) & present(C("new_timestamp")))
    return dated.groupBy(F.substring(C("new_timestamp").cast("string"), 1, 4).alias("year")).agg(F.count("*").alias("transitions"))


def dataset_quality(records: DataFrame) -> DataFrame:
    """One row: provenance and time completeness, provisional share, extensions."""
    provisional = F.count_if(C("label_quality_tier") == "SINGLE_REVIEWER_PROVISIONAL")
    complete = F.count_if(present(C("old_sha256")) & present(C("new_sha256")))
    dated = F.count_if(present(C("old_timestamp")) & present(C("new_timestamp")))
    total = F.count("*")
    return records.agg(
        total.alias("record_count"),
        complete.alias("provenance_complete_count"),
        dated.alias("timestamp_complete_count"),
        F.concat_ws("/", complete.cast("string"), total.cast("string")).alias("provenance_completeness"),
        F.concat_ws("/", dated.cast("string"), total.cast("string")).alias("timestamp_completeness"),
        F.round(ratio(provisional * 100, total), 6).alias("single_reviewer_provisional_percentage"),
        F.count_distinct("extension_id").alias("extension_diversity"),
    )


def analyzer_missingness(features: DataFrame) -> DataFrame:
    """Rows without each optional analyser, and the total."""
    flags = [name for name in features.columns if name.endswith("_available")]
    long = features.select(*[C(name).cast("double").alias(name) for name in flags]).unpivot([], flags, "analyzer_flag", "value")
    counted = long.groupBy("analyzer_flag").agg(F.count_if(C("value") == 0).alias("missing"))
    return counted.unionByName(counted.agg(F.sum("missing").alias("missing")).select(F.lit("total").alias("analyzer_flag"), "missing"))


def compare_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two one-row fact tables side by side: {metric, old_value, new_value}; metrics of either side are kept."""
    def long(frame: DataFrame, value: str) -> DataFrame:
        names = frame.columns
        return frame.select(*[C(name).cast("string").alias(name) for name in names]).unpivot([], names, "metric", value)

    return long(old, "old_value").join(long(new, "new_value"), "metric", "full_outer")


def compare_runs(old: DataFrame, new: DataFrame, keys=("model", "feature_set"), metrics=("f1", "recall", "false_positive_rate")) -> DataFrame:
    """Two result tables side by side on their keys."""
    side = lambda frame, prefix: frame.select(*keys, *[C(name).alias(f"{prefix}_{name}") for name in metrics])
    return side(old, "old").join(side(new, "new"), list(keys))


def label_subsets(rows: DataFrame) -> DataFrame:
    """Counts per label for all rows, higher-confidence rows, real rows and controlled rows."""
    weak = F.coalesce(C("label_quality_tier"), F.lit("")).isin("SINGLE_REVIEWER_PROVISIONAL", "UNCERTAIN", "")
    controlled = F.coalesce(C("is_controlled"), F.lit(False))
    return rows.groupBy("label").agg(
        F.count("*").alias("all_eligible"),
        F.count_if(~weak).alias("higher_confidence"),
        F.count_if(~controlled).alias("real_only"),
        F.count_if(controlled).alias("controlled_only"),
    )
