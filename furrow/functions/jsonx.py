"""JSON packing and field access (ops 2.13, 9.19, 9.20), metrics as VARIANT, array helpers (9.21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions._util import as_col


def pack_metrics(cols: Sequence[str]) -> Column:
    """Non-null metrics as a JSON object (``to_json`` drops null fields)."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def metric_map(cols: Sequence[str]) -> Column:
    """Non-null metrics as ``MAP<STRING, DOUBLE>``."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def json_field(c, key: str, cast: str | None = "double") -> Column:
    """``metrics->>'key'`` (JSON text field access)."""
    v = F.get_json_object(as_col(c), f"$.{key}")
    return v.try_cast(cast) if cast else v


def metrics_variant(c) -> Column:
    """Metrics JSON as VARIANT: parsed once, fields read without parsing again;
    null for text that is no JSON."""
    return F.try_parse_json(as_col(c))


def pack_metrics_variant(cols: Sequence[str]) -> Column:
    """Non-null metrics as a VARIANT object, each with its own type."""
    return F.parse_json(pack_metrics(cols))


def variant_field(c, key: str, cast: str = "double") -> Column:
    """``metrics->>'key'`` of a VARIANT; null if absent, JSON null or of no such value."""
    return F.try_variant_get(as_col(c), f"$.{key}", cast)


def discovered_schema(c) -> Column:
    """Aggregate: the fields and types that a column of VARIANT metrics holds;
    fields of mixed types are ``VARIANT``."""
    return F.schema_of_variant_agg(as_col(c))


def row_json(df_cols: Sequence[str]) -> Column:
    """Whole row as JSON text (nulls dropped), for export of query rows."""
    return F.to_json(F.struct(*[F.col(c) for c in df_cols]))


def normalized_array(c) -> Column:
    """Array elements trimmed and lower-cased."""
    return F.transform(as_col(c), lambda x: F.lower(F.trim(x)))


def array_has_normalized(arr, value) -> Column:
    """Trimmed, lower-cased ``value`` is in the trimmed, lower-cased array."""
    return F.array_contains(normalized_array(arr), F.lower(F.trim(as_col(value))))


def join_array(c, sep: str = ", ") -> Column:
    return F.array_join(as_col(c), sep)
