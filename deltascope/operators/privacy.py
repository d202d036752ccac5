"""Checks that nothing hidden or private is in a table that leaves the project."""
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deltascope import vocab
from deltascope.functions.numbers import fixed_array

C = F.col


def schema_keys(schema: T.DataType, prefix: str = "") -> list[tuple[str, str]]:
    """All field names of a schema with their dotted place, nested ones included."""
    if isinstance(schema, T.StructType):
        found = []
        for field in schema.fields:
            place = f"{prefix}.{field.name}" if prefix else field.name
            found += [(field.name, place), *schema_keys(field.dataType, place)]
        return found
    if isinstance(schema, T.ArrayType):
        return schema_keys(schema.elementType, prefix + "[]")
    if isinstance(schema, T.MapType):
        return schema_keys(schema.valueType, prefix + "{}")
    return []


def forbidden_columns(frame: DataFrame, forbidden: list[str] | None = None) -> list[str]:
    """Places in a table schema that carry a forbidden key."""
    blocked = set(vocab.FORBIDDEN_PACKET_KEYS if forbidden is None else forbidden)
    return [place for name, place in schema_keys(frame.schema) if name in blocked]


def private_columns(frame: DataFrame) -> list[str]:
    """Places in a table schema whose key contains a prohibited fragment."""
    return [place for name, place in schema_keys(frame.schema) if any(part in name.lower() for part in vocab.PRIVATE_KEY_FRAGMENTS)]


def json_keys(text: Column) -> Column:
    """Distinct object keys anywhere in JSON text."""
    # All strings are cut out in turn, so a quoted text inside a value is no key; the group has those before a colon.
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    quoted = F.regexp_extract_all(text, F.lit(rf"({string})\s*+:|{string}"), F.lit(1))
    keys = F.array_distinct(F.filter(quoted, lambda item: item != ""))
    return F.transform(keys, lambda item: F.substring(item, F.lit(2), F.length(item) - 2))


def forbidden_json_keys(rows: DataFrame, column: str, forbidden: list[str] | None = None, key: str = "record_id") -> DataFrame:
    """{key, forbidden_key} for every forbidden key anywhere in a JSON text column."""
    blocked = fixed_array(vocab.FORBIDDEN_PACKET_KEYS if forbidden is None else forbidden)
    return rows.select(key, F.explode(F.array_intersect(json_keys(C(column)), blocked)).alias("forbidden_key"))


def private_json_keys(rows: DataFrame, column: str, key: str = "record_id") -> DataFrame:
    """{key, private_key} for every key that contains a prohibited fragment."""
    fragments = fixed_array(vocab.PRIVATE_KEY_FRAGMENTS)
    bad = F.filter(json_keys(C(column)), lambda name: F.exists(fragments, lambda part: F.lower(name).contains(part)))
    return rows.select(key, F.explode(bad).alias("private_key"))


def private_values(rows: DataFrame, columns: list[str], key: str = "record_id") -> DataFrame:
    """{key, place, violation} for values that look like an email, a private path or a private id.

    Whole values are searched. Every column is tested where it is, so no row is multiplied.
    """
    tests = [
        F.when(C(name).rlike(pattern), F.struct(F.lit(name).alias("place"), F.lit(kind).alias("violation")))
        for name in columns
        for kind, pattern in vocab.PRIVATE_VALUE_PATTERNS.items()
    ]
    return rows.select(key, F.inline(F.array_compact(F.array(*tests))))
