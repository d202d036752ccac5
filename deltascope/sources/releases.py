"""Choice of one asset per release."""
from pyspark.sql import DataFrame, functions as F

C = F.col


def select_assets(assets: DataFrame, specs: DataFrame) -> DataFrame:
    """First asset, in list order, that meets any rule of its source.

    assets {source_id, release, position, name}; specs {source_id, asset_name, asset_contains,
    asset_prefix, asset_suffix}, blank or null rules do not count. The rules are settings and go to all tasks: a join by
    source would deal all assets of a source to one.
    """
    given = lambda name: F.coalesce(C(name) != "", F.lit(False))
    suffix = C("name").endswith(F.coalesce("asset_suffix", F.lit("")))
    meets = (
        (given("asset_name") & (C("name") == C("asset_name")))
        | (given("asset_contains") & C("name").contains(C("asset_contains")) & suffix)
        | (given("asset_prefix") & C("name").startswith(C("asset_prefix")) & suffix)
    )
    matched = assets.join(F.broadcast(specs), "source_id").where(F.coalesce(meets, F.lit(False)))
    return matched.groupBy("source_id", "release").agg(F.min_by("name", "position").alias("name"))
