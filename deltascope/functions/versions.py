"""Version strings and ISO timestamps."""
from pyspark.sql import Column, functions as F

# Fixed value: the ISO-8601 shapes that are read as a time
ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def version_key(version: Column) -> Column:
    """All digit runs as numbers of any length; null when there is none. Arrays compare element by element."""
    runs = F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(runs) > 0, F.transform(F.transform(runs, lambda run: F.ltrim(run, F.lit("0"))), lambda run: F.struct(F.length(run).alias("digits"), run.alias("run"))))


def iso_time(value: Column) -> Column:
    """Timestamp of ISO text; blank or invalid text gives null."""
    return F.when(F.coalesce(value, F.lit("")).rlike(ISO_SHAPE), F.try_to_timestamp(value))


def compare_versions(old_version, new_version, old_time=None, new_time=None) -> Column:
    """1 when new is later, -1 when earlier, 0 when equal, null when unknown. Times win over version text."""
    none = F.lit(None).cast("string")
    t_old, t_new = iso_time(none if old_time is None else old_time), iso_time(none if new_time is None else new_time)
    k_old, k_new = version_key(old_version), version_key(new_version)
    return (
        F.when(
            t_old.isNotNull() & t_new.isNotNull(),
            F.when(t_new > t_old, 1).when(t_new < t_old, -1).otherwise(0),
        )
        .when(k_old.isNull() | k_new.isNull(), F.lit(None).cast("int"))
        .otherwise(F.when(k_new > k_old, 1).when(k_new < k_old, -1).otherwise(0))
    )


def order_class(version: Column, timestamp: Column) -> Column:
    """0 for dated versions, 1 for numbered ones, 2 for the rest."""
    return (
        F.when(iso_time(timestamp).isNotNull(), 0).when(version_key(version).isNotNull(), 1).otherwise(2)
    )
