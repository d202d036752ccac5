"""Arithmetic shared by the score and metric operators."""
from functools import reduce

from pyspark.sql import Column, functions as F


def half_even(value: Column, digits: int = 1) -> Column:
    return F.bround(value, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 when the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def capped(value: Column, limit: float) -> Column:
    return F.least(value, F.lit(float(limit)))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def max_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.max(F.when(condition, value)), F.lit(0))


def any_where(condition: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def present(value: Column) -> Column:
    """Neither null nor blank text."""
    return value.isNotNull() & (value.cast("string") != "")


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in rule order."""
    return F.array_compact(
        F.array(*[F.when(condition, F.lit(message) if isinstance(message, str) else message) for condition, message in rules])
    )


def sql_text(value: str) -> str:
    """A string literal for a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return sql_text(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value).lower() if isinstance(value, bool) else str(value)


def fixed_array(values: list, kind: str = "string") -> Column:
    """A small fixed list as an array literal."""
    return F.expr(f"cast(array({', '.join(_sql_value(value) for value in values)}) as array<{kind}>)")


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a small fixed table, as a map literal inside the expression."""
    if not table:
        return F.lit(default)
    entries = ", ".join(f"{_sql_value(name)}, {_sql_value(value)}" for name, value in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), key), F.lit(default))
