"""Ordered computations give the same result however the rows are cut."""
import pytest
from pyspark.sql import Window, functions as F

from deltascope.operators import ordering, versions


@pytest.fixture
def rows(spark):
    # One group holds a third of all rows.
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("g"), (F.col("id") * 7919 % 3001).alias("v"), "id"
    )


@pytest.mark.parametrize("parts", ["1", "7", "64"])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_positions(spark, rows, group, parts):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {row.id: row.position for row in ordering.positioned(rows, [-F.col("v"), F.col("id")], group).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    wanted = rows.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("v"), "id"))).collect()
    assert found == {row.id: row.n for row in wanted}


def test_next_row(spark, rows):
    found = {row.id: row.next_id for row in ordering.with_next(rows, ["g"], [F.col("v"), F.col("id")], ["id"]).collect()}
    wanted = rows.withColumn("n", F.lead("id").over(Window.partitionBy("g").orderBy("v", "id"))).collect()
    assert found == {row.id: row.n for row in wanted}


@pytest.mark.parametrize("large", [100, 1 << 17])
def test_next_row_of_large_and_small_groups(spark, monkeypatch, rows, large):
    """Groups that are cut and groups that are not; the rows without a key are one group."""
    monkeypatch.setattr(ordering, "LARGE", large)
    keyed = rows.withColumn("g", F.when(F.col("g") > 0, F.when(F.col("g") < 90, F.col("g"))))
    found = {row.id: row.next_id for row in ordering.with_next(keyed, ["g"], [F.col("v"), F.col("id")], ["id"]).collect()}
    wanted = keyed.withColumn("n", F.lead("id").over(Window.partitionBy("g").orderBy("v", "id"))).where("g is not null").collect()
    assert len(found) == 3000 and all(found[row.id] == row.n for row in wanted)


def test_small_groups_have_no_bounds(spark, monkeypatch, rows):
    """Bounds are for the rows of large groups only."""
    cuts = ordering._cuts(rows, [F.col("v"), F.col("id")], ["g"]).agg(F.max("_cut").alias("most")).first()
    assert cuts.most == 0
    monkeypatch.setattr(ordering, "LARGE", 500)
    cut = ordering._cuts(rows, [F.col("v"), F.col("id")], ["g"]).where("_cut > 0").select("g").distinct().collect()
    assert [row.g for row in cut] == [0]


def test_keys_are_not_built_again_for_every_bound(spark, rows):
    made = ordering.with_next(rows, ["g"], [F.col("v") * 2, F.col("id")], ["id"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan and "< struct(" not in plan and "< named_struct(" not in plan


def test_no_job_runs_while_a_plan_is_built(spark, rows):
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    ordering.positioned(rows, [F.col("v"), F.col("id")])
    ordering.with_next(rows, ["g"], [F.col("v"), F.col("id")], ["id"])
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_versions_with_long_numbers(spark):
    from deltascope.functions import versions as v

    frame = spark.createDataFrame([("1." + "9" * 40, "1." + "1" + "0" * 40), ("1.010", "1.10"), ("2", "10")], "a string, b string")
    assert [row.c for row in frame.select(v.compare_versions(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0, 1]


def test_chain_order_of_mixed_versions(spark):
    rows = [("e", "2.0", "2024-03-01T00:00:00Z", "c"), ("e", "9.0", "2024-01-01", "a"), ("e", "1.10", None, "n2"), ("e", "1.9", None, "n1"), ("e", "beta", None, "z")]
    frame = spark.createDataFrame(rows, "extension_id string, version string, timestamp string, package_id string")
    pairs = versions.consecutive_pairs(frame).collect()
    assert sorted(row.pair_id for row in pairs) == sorted(["a->c", "c->n1", "n1->n2", "n2->z"])
