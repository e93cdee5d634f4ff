"""Layered configuration: which value is in effect, and what it reads as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_config(rows: DataFrame) -> DataFrame:
    """Value of the first source that has one, per (app, node, property).

    ``rows(app, node, property, value, priority)``; the lowest priority number comes first.
    """
    present = F.col("value").isNotNull()
    return (
        rows.filter(present)
        .groupBy("app", "node", "property")
        .agg(F.min_by(F.struct("value", "priority"), F.struct("priority", "value")).alias("v"))
        .select("app", "node", "property", "v.value", F.col("v.priority").alias("source"))
    )


def as_number(value: Column, kind: str, default) -> Column:
    """A number, or the default when the text is not one."""
    if kind in ("int", "bigint"):
        value = F.when(value.rlike("^[+-]?[0-9]+$"), value)
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def as_flag(value: Column, default: bool) -> Column:
    """True only for ``true`` in any case; the default only for a missing value."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(value) == "true")


def as_choice(value: Column, choices: list[str], default: str) -> Column:
    return F.when(value.isin(choices), value).otherwise(F.lit(default))


def as_list(value: Column) -> Column:
    """Comma list with the white space around each item removed; trailing empty items fall off."""
    return F.transform(
        F.split(F.regexp_replace(value, ",+$", ""), ","),
        lambda item: F.regexp_replace(item, r"^\s+|\s+$", ""),
    )


def typed_config(values: DataFrame, types: dict[str, tuple[str, object]]) -> DataFrame:
    """Effective values read as ``types[property] = (kind, default)``, as text of that kind."""
    value, name = F.col("value"), F.col("property")
    typed = value
    for prop, (kind, default) in types.items():
        if kind == "boolean":
            read = as_flag(value, bool(default)).cast("string")
        else:
            read = as_number(value, kind, default).cast("string")
        typed = F.when(name == prop, read).otherwise(typed)
    return values.withColumn("typed", typed)
