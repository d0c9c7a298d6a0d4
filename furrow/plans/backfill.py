"""Yearly backfill as Spark jobs: landed payloads -> completeness
-> normalise -> grain merge -> partitioned facts.

Every step is a library function; this module only chains them.  Nothing is
handed through the driver: each stage reads what the previous one wrote (or
stays in one lazy plan), like the reference's object-store hand-off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import merge, normalize, quality
from furrow.sinks import partitioned


def check_daily_completeness(df: DataFrame, keys: Sequence[str], date_col: str, start: str, end: str,
                             strict: bool = False) -> DataFrame:
    """Missing days per key between ``start`` and ``end`` (raises when ``strict``)."""
    gaps = quality.missing_dates(df, keys, date_col, start, end)
    if strict:
        first = gaps.limit(1).collect()
        if first:
            raise quality.DataQualityError(f"missing days, e.g. {first[0].asDict()}")
    return gaps


def backfill_daily(point_long: DataFrame, archive_daily: DataFrame, out_root: str, as_of,
                   keys: Sequence[str] = ("location",), date_col: str = "date") -> dict[str, str]:
    """Normalise both daily sources and write each to ``<out_root>/daily/<source>``
    partitioned by year, sorted by key and date inside files."""
    keys = list(keys)
    nasa = normalize.nasapower_daily(point_long, as_of, keys)
    om = normalize.openmeteo_daily(archive_daily, as_of, keys, date_col)
    paths = {"nasapower": f"{out_root.rstrip('/')}/daily/nasapower",
             "openmeteo": f"{out_root.rstrip('/')}/daily/openmeteo"}
    partitioned.write_partitioned(nasa, paths["nasapower"], "date", ("year",), sort_cols=keys)
    partitioned.write_partitioned(om, paths["openmeteo"], date_col, ("year",), sort_cols=keys)
    return paths


def backfill_hourly(archive_hourly: DataFrame, nasa_daily_path: str, out_root: str, as_of,
                    keys: Sequence[str] = ("location",), date_col: str = "date") -> str:
    """Normalise hourly pressure, spread the normalised point-series daily
    metrics on every hour of the day (op 4.1), write ``yyyymm`` partitions."""
    keys = list(keys)
    hourly = normalize.openmeteo_hourly(archive_hourly, as_of, keys, date_col).drop("source")
    daily = (hourly.sparkSession.read.parquet(nasa_daily_path)
             .drop("year", "source"))
    merged = merge.spread_daily_on_hourly(hourly, daily, keys, ts_col=date_col, day_col="date")
    path = f"{out_root.rstrip('/')}/hourly/merged"
    partitioned.write_partitioned(merged, path, date_col, ("yyyymm",), sort_cols=keys)
    return path


def expected_hourly_rows(df: DataFrame, keys: Sequence[str], ts_col: str) -> DataFrame:
    """Per key and day: hours present against the 24 expected."""
    return (df.groupBy(*keys, F.to_date(ts_col).alias("day")).agg(F.count(F.lit(1)).alias("hours"))
            .withColumn("complete", F.col("hours") == 24))
