"""Version chains: ordering of the versions of an entity and its consecutive pairs."""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope.functions import versions as v
from deltascope.operators.ordering import with_next


def chain_order() -> list[Column]:
    """Dated versions by time, then numbered ones by number, then the rest by text; package id settles ties."""
    return [F.col("_class"), F.col("_time"), F.col("_number"), F.col("version"), F.col("package_id")]


def with_chain_keys(versions: DataFrame) -> DataFrame:
    version, timestamp = F.col("version"), F.col("timestamp")
    kind = v.order_class(version, timestamp)
    return versions.withColumns(
        {"_class": kind, "_time": v.iso_time(timestamp), "_number": F.when(kind == 1, v.version_key(version))}
    )


def consecutive_pairs(versions: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Pairs of neighbours in each chain from {extension_id, version, timestamp, package_id, extra...}."""
    carried = ["package_id", "version", "timestamp", *extra]
    chained = with_next(with_chain_keys(versions), ["extension_id"], chain_order(), carried, "new_")
    pairs = chained.where(F.col("new_package_id").isNotNull())
    return pairs.select(
        F.concat_ws("->", F.col("package_id").cast("string"), F.col("new_package_id").cast("string")).alias("pair_id"),
        "extension_id",
        *[F.col(name).alias(f"old_{name}") for name in carried],
        *[f"new_{name}" for name in carried],
    )
