"""Payload values: JSON text to typed columns and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(payload: Column | str, field: str, kind: str) -> Column:
    """A payload field as a SQL type; a missing field, or a value of another kind, is null."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.try_variant_get(F.try_parse_json(F.try_element_at(payload, F.lit(field))), "$", kind)


def encode(**fields: Column) -> Column:
    """A payload map of columns: each value as JSON text."""
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(json_text, fields.values())))


def json_text(c: Column) -> Column:
    """JSON text of one value: that of a one-field object without its frame."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)
