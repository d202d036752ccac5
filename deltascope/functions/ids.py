"""Identifiers derived from content."""
from pyspark.sql import Column, functions as F


def joined_id(prefix: str, *parts: Column) -> Column:
    """prefix::part::part, an error when a part is blank or holds the separator."""
    valid = F.lit(True)
    for part in parts:
        valid = valid & part.isNotNull() & (part != "") & ~part.contains("::")
    return F.when(valid, F.concat_ws("::", F.lit(prefix), *parts)).otherwise(
        F.raise_error(F.lit("id parts must be nonempty and must not contain '::'"))
    )


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a struct or map as JSON with sorted keys (a variant keeps its keys sorted)."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(value, {"ignoreNullFields": "false"}))), 256)


def safe_name(value: Column) -> Column:
    """Text reduced to characters that are safe in file names, an error when nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned != "", F.substring(cleaned, 1, 180)).otherwise(
        F.raise_error(F.lit("filename is empty after sanitization"))
    )


def alias_is_swapped(record_id: Column, prefix: str = "reviewer-alias-v1") -> Column:
    """Whether the first reviewer takes the second alias: parity of the first hash byte."""
    digest = F.sha2(F.concat(F.lit(prefix + "::"), record_id), 256)
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2 == 1
