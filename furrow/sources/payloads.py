"""Weather API payloads to rows (ops 1.5-1.8).

Payloads are landed as JSON files, one per request; each reader takes either
a DataFrame already holding the payload columns or a landing path read with
an explicit schema (no inference job).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.dates import parse_compact_date

POINT_SERIES_SCHEMA = T.StructType([
    T.StructField("properties", T.StructType([
        T.StructField("parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    ])),
])


def read_point_series(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Point-series JSON payloads (``properties.parameter.<code>.<yyyyMMdd>``)."""
    schema = POINT_SERIES_SCHEMA
    if extra:
        schema = T.StructType(schema.fields + extra.fields)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def point_series_to_long(df: DataFrame, map_col: str = "properties.parameter",
                         keys: Sequence[str] = ()) -> DataFrame:
    """``parameter -> {yyyyMMdd: value}`` to ``(keys, date, parameter, value)`` (op 1.5)."""
    outer = df.select(*keys, F.explode(F.col(map_col)).alias("parameter", "__series"))
    inner = outer.select(*keys, "parameter", F.explode("__series").alias("__day", "value"))
    return inner.select(*keys, parse_compact_date("__day").alias("date"), "parameter", "value")


def arrays_to_rows(df: DataFrame, time_col: str, metric_cols: Sequence[str],
                   keys: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """Parallel arrays ``time[], m1[], m2[] ...`` to one row per position (op 1.6).

    ``prefix`` (``"daily"`` / ``"hourly"``) reads the arrays from that struct.
    """
    def ref(c):
        return F.col(f"{prefix}.{c}") if prefix else F.col(c)
    zipped = F.arrays_zip(ref(time_col).alias(time_col), *[ref(c).alias(c) for c in metric_cols])
    return df.select(*keys, F.inline(zipped))


def regular_series_to_rows(df: DataFrame, start_col: str, end_col: str, step_seconds: int,
                           metric_cols: Sequence[str], keys: Sequence[str] = (),
                           time_name: str = "date") -> DataFrame:
    """Series given as ``(start, end, step)`` plus value arrays, end excluded (ops 1.7, 9.6).

    ``start``/``end`` are epoch seconds; times are UTC without zone.
    """
    start = F.col(start_col).cast("long")
    end = F.col(end_col).cast("long")
    times = F.sequence(start, end - step_seconds, F.lit(step_seconds).cast("long"))
    times = F.when(end > start, times).otherwise(F.array().cast("array<bigint>"))
    zipped = F.arrays_zip(times.alias("__t"), *[F.col(c).alias(c) for c in metric_cols])
    rows = df.select(*keys, F.inline(zipped))
    return rows.select(*keys, F.timestamp_seconds("__t").cast("timestamp_ntz").alias(time_name),
                       *metric_cols).where(F.col(time_name).isNotNull())


def point_series_to_wide(df: DataFrame, codes: Sequence[str], map_col: str = "properties.parameter",
                         keys: Sequence[str] = ()) -> DataFrame:
    """Payload straight to a date-indexed wide frame, sorted (op 1.8)."""
    long = point_series_to_long(df, map_col, keys)
    wide = long.groupBy(*keys, "date").pivot("parameter", list(codes)).agg(F.first("value"))
    return wide.orderBy(*keys, "date")
