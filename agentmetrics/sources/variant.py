"""Short access to fields of a parsed JSON value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null


def field(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, "$." + path, kind)


def text(value: Column, path: str) -> Column:
    """A string field; empty text counts as absent."""
    return blank_to_null(field(value, path, "string"))


def items(value: Column, path: str) -> Column:
    """An array field; null when the field is not an array."""
    return field(value, path, "array<variant>")


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)
