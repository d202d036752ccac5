"""Group-safe split assignment."""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope import vocab
from deltascope.functions.versions import iso_time
from deltascope.operators.ordering import positioned


def check_ratios(train: float, validation: float, test: float) -> None:
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1.0")
    if min(train, validation, test) < 0:
        raise ValueError("split ratios must be non-negative")


def _cut(groups: DataFrame, order: list[Column], train: float, validation: float) -> DataFrame:
    total = groups.agg(F.count("*")).scalar()
    share = lambda ratio: F.floor(F.col("_total") * F.lit(float(ratio)))
    place, first = F.col("position"), share(train)
    return positioned(groups, order).withColumn("_total", total).select(
        "extension_id", F.when(place <= first, "train").when(place <= first + share(validation), "validation").otherwise("test").alias("split")
    )


def random_group_split(records: DataFrame, train=0.7, validation=0.15, test=0.15, seed: int = 1337) -> DataFrame:
    """{extension_id, split}: extensions in hash order of a seed, cut by whole-number ratios."""
    check_ratios(train, validation, test)
    groups = records.select("extension_id").distinct()
    shuffled = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("extension_id").cast("string")), 256)
    return _cut(groups, [shuffled, F.col("extension_id")], train, validation)


def chronological_group_split(records: DataFrame, train=0.7, validation=0.15, test=0.15) -> DataFrame:
    """{extension_id, split}: extensions by their latest new version; one without a time comes last."""
    check_ratios(train, validation, test)
    time = iso_time(F.col("new_timestamp")) if dict(records.dtypes)["new_timestamp"] == "string" else F.col("new_timestamp")
    groups = records.groupBy("extension_id").agg(
        F.bool_or(time.isNull()).alias("_undated"), F.max(time).alias("_latest")
    )
    latest = F.when(~F.col("_undated"), F.col("_latest"))
    return _cut(groups, [F.col("_undated"), latest, F.col("extension_id")], train, validation)


def apply_split(records: DataFrame, assignments: DataFrame, required: bool = False) -> DataFrame:
    """Give every record the split of its extension; a missing one is null, or an error when required."""
    joined = records.drop("split").join(assignments.select("extension_id", "split"), "extension_id", "left")
    if not required:
        return joined
    missing = F.raise_error(F.concat(F.lit("missing split assignment for "), F.col("extension_id").cast("string")))
    return joined.withColumn("split", F.coalesce("split", missing.cast("string")))


def chronological_order(rows: DataFrame) -> DataFrame:
    """Rows by transition time; a row without a valid time is an error."""
    time = F.coalesce(
        iso_time(F.col("new_timestamp")),
        F.raise_error(F.lit("all rows must have valid new_timestamp values")).cast("timestamp"),
    )
    return rows.withColumn("_time", time).orderBy("_time").drop("_time")


def chronological_status(rows: DataFrame) -> DataFrame:
    """One row: whether a chronological evaluation can be run, and why not."""
    dated = F.count_if(iso_time(F.col("new_timestamp")).isNotNull())
    facts = rows.agg(
        F.count("*").alias("records"), dated.alias("qualified_record_count"),
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"),
    )
    undated = (F.col("records") == 0) | (F.col("qualified_record_count") != F.col("records"))
    unsplit = (F.col("train") == 0) | (F.col("test") == 0)
    return facts.select(
        F.when(undated | unsplit, "not_run_unavailable_timestamps_or_splits").otherwise("ready").alias("status"),
        "qualified_record_count",
        F.when(undated, "missing or invalid transition timestamps")
        .when(unsplit, "train/test split assignments unavailable")
        .otherwise("timestamps and train/test splits are available")
        .alias("reason"),
    )


def chronological_class_support(rows: DataFrame, needed: int = 5) -> DataFrame:
    """One row: dated eligible records, extensions, and whether the risky class is large enough."""
    risky = F.col("label") == "risky_transition"
    facts = rows.agg(
        F.count("*").alias("qualified_record_count"),
        F.count_if(risky).alias("risky_record_count"),
        F.count_distinct("extension_id").alias("qualified_extension_count"),
        F.count_distinct(F.when(risky, F.col("extension_id"))).alias("risky_extension_count"),
    )
    return facts.withColumn(
        "status",
        F.when(F.col("risky_record_count") < needed, "not_reliable_class_support_too_small").otherwise("not_reliable_pilot_too_small"),
    )
