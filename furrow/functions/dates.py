"""Date and time functions (ops 9.1-9.9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions._util import as_col

# Ingestion timing rules.
HISTORY_LAG_DAYS = 2
FORECAST_HORIZON_DAYS = 7


def parse_compact_date(c) -> Column:
    """``yyyyMMdd`` text to DATE (point-series payload keys)."""
    return F.to_date(as_col(c), "yyyyMMdd")


def parse_iso_date(c) -> Column:
    return F.to_date(as_col(c), "yyyy-MM-dd")


def parse_iso_timestamp(c) -> Column:
    """ISO-8601 text, with or without an offset, to a UTC timestamp without zone."""
    return F.to_timestamp(as_col(c)).cast("timestamp_ntz")


def epoch_to_timestamp(c) -> Column:
    """Epoch seconds to a UTC timestamp (no zone)."""
    return F.timestamp_seconds(as_col(c)).cast("timestamp_ntz")


def day_floor(c) -> Column:
    """Timestamp floored to midnight, same type."""
    return F.date_trunc("day", as_col(c))


def day_of(c) -> Column:
    return F.to_date(as_col(c))


def yyyymm(c) -> Column:
    c = as_col(c)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def shift_years(c, years: int) -> Column:
    return F.add_months(as_col(c), 12 * years)


def shift_days(c, days) -> Column:
    return F.date_add(as_col(c), days)


def history_target(run_date, lag_days: int = HISTORY_LAG_DAYS) -> Column:
    """The day an incremental history run loads: run date minus the lag (op 9.9)."""
    return F.date_sub(as_col(run_date), lag_days)


def forecast_days(run_date, horizon: int = FORECAST_HORIZON_DAYS) -> Column:
    """Array of days run_date .. run_date + horizon (op 9.8)."""
    d = as_col(run_date)
    return F.sequence(d, F.date_add(d, horizon))


def source_for_window(window_end, today) -> Column:
    """A window that ends on or before today is served by the archive, else the forecast."""
    return F.when(as_col(window_end) <= as_col(today), F.lit("archive")).otherwise(F.lit("forecast"))


def drop_zone(c) -> Column:
    """Instant to wall-clock UTC (session zone is UTC) without zone (op 9.7)."""
    return as_col(c).cast("timestamp_ntz")
