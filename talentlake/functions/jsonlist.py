"""Tolerant reading of JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


def json_list(value: Column | str) -> Column:
    """Array of strings from JSON text; bad JSON, null or a non-list give an empty array.

    Items may be strings or objects with a ``name``.
    """
    parsed = F.from_json(as_column(value), "array<string>")
    names = F.transform(
        parsed, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)
    )
    return F.coalesce(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != "")), F.array().cast("array<string>"))


def json_list_text(value: Column | str, sep: str = "; ") -> Column:
    """The items joined; text that is not a JSON list is kept as it is, null gives ''."""
    c = as_column(value)
    parsed = F.from_json(c, "array<string>")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(
        F.coalesce(F.when(F.trim(c).startswith("["), F.array_join(parsed, sep)), c)
    )
