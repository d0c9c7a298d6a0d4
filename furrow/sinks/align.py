"""Schema alignment for wide fact tables (ops 2.7-2.9, 3.14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wide fact column order (daily grain) of the warehouse tables.
WIDE_DAILY_COLUMNS = ["date_mesure", "extraction_date", "city_name", "latitude", "longitude",
                      "temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "precipitation_sum"]


def align_to(df: DataFrame, columns: Sequence[str], types: dict[str, T.DataType] | None = None,
             numeric: Sequence[str] = ()) -> DataFrame:
    """Project to a fixed column order; absent columns become typed nulls;
    ``numeric`` columns are coerced with ``try_cast`` (ops 2.7, 2.8)."""
    types = types or {}
    out = []
    for c in columns:
        t = types.get(c, T.DoubleType() if c in numeric else None)
        if c in df.columns:
            col = F.col(c)
            if c in numeric:
                col = col.cast("string").try_cast("double")
            elif t is not None:
                col = col.cast(t)
        else:
            col = F.lit(None).cast(t or T.StringType())
        out.append(col.alias(c))
    return df.select(*out)


def prepare_wide_append(df: DataFrame, city: str, latitude: float, longitude: float,
                        date_col: str = "date", target_date: str = "date_mesure",
                        columns: Sequence[str] = WIDE_DAILY_COLUMNS,
                        metric_types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Rename the date column, add constant city/lat/lon, add absent metrics
    as nulls, drop the zone, project to ``columns`` (op 2.7)."""
    if isinstance(df.schema[date_col].dataType, T.TimestampType):
        # zone-aware instant -> UTC wall clock without zone (session zone is UTC)
        df = df.withColumn(date_col, F.col(date_col).cast("timestamp_ntz"))
    base = (df.withColumnRenamed(date_col, target_date)
            .withColumn("city_name", F.lit(city))
            .withColumn("latitude", F.lit(float(latitude)))
            .withColumn("longitude", F.lit(float(longitude))))
    metrics = [c for c in columns if c not in ("date_mesure", "extraction_date", "city_name", "latitude", "longitude")]
    return align_to(base, columns, {**(metric_types or {}), "city_name": T.StringType(),
                                    "latitude": T.DoubleType(), "longitude": T.DoubleType()}, numeric=metrics)


def union_evolving(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames whose metric sets grow over time: new columns are
    added, missing ones are null (op 2.9; ``mergeSchema`` on read is the file
    side of the same rule)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def add_metadata(df: DataFrame, source: str, extraction_date) -> DataFrame:
    """``extraction_date`` (a parameter, never the clock) and ``source`` (op 3.14)."""
    return df.withColumn("extraction_date", F.lit(extraction_date).cast("date")).withColumn("source", F.lit(source))
