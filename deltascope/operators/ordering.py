"""Ordered computations over groups of any size.

A group of at most LARGE rows is ordered by one window. The rows of a larger one are cut at bounds of the order, so
that no task has to hold a whole group; what a row needs from other cuts is one row for each group and cut, and is
joined back. The bounds come from a bounded random sample of the rows of large groups, read as a scalar within the
same plan: the result does not depend on them, nothing runs before the result is asked for, and there is one plan for
every size.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a group that one task orders.
LARGE = 1 << 17
#: Rows that the bounds are chosen from: one at random for each of so many buckets of a hash.
SAMPLE = 4096


def _marked(frame: DataFrame, group: list[str]) -> DataFrame:
    """The frame with `_large`: true for rows of groups that are cut, else null. Without a group, all rows are one."""
    if not group:
        return frame.withColumn("_large", F.lit(True))
    names = [f"_group{at}" for at in range(len(group))]
    keys = [F.col(key).alias(name) for key, name in zip(group, names)]
    large = frame.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > LARGE).select(*names, F.lit(True).alias("_large"))
    same = reduce(lambda left, right: left & right, [F.col(key).eqNullSafe(F.col(name)) for key, name in zip(group, names)])
    # One row for each LARGE rows at most.
    return frame.join(F.broadcast(large), same, "left").drop(*names)


def _cuts(frame: DataFrame, order: list[Column], group: list[str]) -> DataFrame:
    """The frame with `_large` and with `_cut`, the number of bounds below the row if its group is large, else 0."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = _marked(frame, group)
    key = F.struct(*[column.alias(f"k{at}") for at, column in enumerate(order)])
    hashed = frame.where("_large").select(key.alias("_key")).withColumn("_hash", F.xxhash64("_key"))
    sample = hashed.groupBy(F.pmod("_hash", F.lit(SAMPLE)).alias("_bucket")).agg(F.min_by("_key", "_hash").alias("_key"))
    ordered = sample.agg(F.array_sort(F.collect_list("_key")).alias("keys"))
    step = F.greatest(F.ceil(F.size("keys") / F.lit(parts)), F.lit(1))
    bounds = ordered.select(F.filter("keys", lambda item, at: (at + 1) % step == 0).alias("bounds"))
    # There are at most `parts` bounds: halving steps find the place. The key is one element of an array, as what a lambda
    # names is evaluated again for every bound it is compared with.
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(parts.bit_length()))])
    place = lambda own: F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) < own, at + step).otherwise(at)
    )
    return frame.withColumn("_bounds", F.when(F.col("_large"), bounds.scalar())).withColumn(
        "_cut", F.when(F.col("_large"), F.element_at(F.transform(F.array(key), place), 1)).otherwise(0)
    ).drop("_bounds")


def positioned(frame: DataFrame, order: list[Column], group: list[str] = (), name: str = "position") -> DataFrame:
    """Add the 1-based place of each row in its group. `order` is ascending and must not leave ties."""
    group = list(group)
    cut = _cuts(frame, order, group)
    inside = F.row_number().over(Window.partitionBy(*group, "_cut").orderBy(*order))
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*group, "_cut").agg(F.count("*").alias("_size"))
    offsets = sizes.select(*group, "_cut", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    joined = cut.withColumn("_inside", inside).join(offsets, [*group, "_cut"])
    return joined.withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long")).select(*frame.columns, name)


def with_next(frame: DataFrame, group: list[str], order: list[Column], columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add the given columns of the following row of the group (null for the last). `order` is ascending and must not leave ties."""
    group = list(group)
    row, key = F.struct(*columns), F.struct(*order)
    cut = _cuts(frame, order, group)
    heads = cut.where("_large").groupBy(*group, "_cut").agg(F.min_by(row, key).alias("_head"))
    heads = heads.select(*group, "_cut", F.lead("_head").over(Window.partitionBy(*group).orderBy("_cut")).alias("_head"))
    inside = F.lead(row).over(Window.partitionBy(*group, "_cut").orderBy(*order))
    marked = cut.withColumn("_inside", inside).join(heads.where("_head is not null"), [*group, "_cut"], "left")
    marked = marked.withColumn("_next", F.coalesce("_inside", "_head"))
    return marked.select(*frame.columns, *[F.col(f"_next.{name}").alias(f"{prefix}{name}") for name in columns])
