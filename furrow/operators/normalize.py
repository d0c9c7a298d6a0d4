"""Source normalisers: cleaning rules in the reference order.

Every pipeline is one lazy plan: row-local rules are a single projection
(whole-stage codegen), fills are windows of ``furrow.operators.fill`` per
(location, year) series, which the calendar bounds.  With ``counts`` (an
Observation) each reports what it is about to repair, counted while the rows pass
on their way to the write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from furrow.functions import cleaning as C
from furrow.operators import fill
from furrow.operators.dedup import first_by_key
from furrow.operators.quality import observe, rule_counts
from furrow.operators.reshape import POINT_SERIES_NAMES, pivot_long_wide
from furrow.sinks.align import add_metadata

DAILY_TEMPS = ["temperature_2m_mean", "temperature_2m_max", "temperature_2m_min"]
ALL_SKY = "all_sky_surface_shortwave_radiation_downward"
CLEAR_SKY = "clear_sky_surface_shortwave_radiation_downward"


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def cleaning_counts(df: DataFrame) -> list[Column]:
    """Aggregates over the coerced values before cleaning, for the columns that
    ``df`` has: what the rules are about to repair, and the range of each metric
    (op 5.15)."""
    rules, col = {}, {c: F.col(c) for c in df.columns}
    for c in _present(df, [*DAILY_TEMPS]):
        rules[f"{c}_outside"] = ~col[c].between(*C.TEMPERATURE_BOUNDS)
    if "surface_pressure" in col:
        rules["surface_pressure_outside"] = ~col["surface_pressure"].between(*C.PRESSURE_BOUNDS)
    if "temperature_2m_max" in col and "temperature_2m_min" in col:
        rules["temperature_swapped"] = col["temperature_2m_min"] > col["temperature_2m_max"]
    if "precipitation_sum" in col:
        rules["precipitation_negative"] = col["precipitation_sum"] < 0
        rules["precipitation_high"] = col["precipitation_sum"] > C.PRECIP_MAX
    if "relative_humidity_2m" in col:
        rules["humidity_clipped"] = ~col["relative_humidity_2m"].between(*C.HUMIDITY_BOUNDS)
    if "wind_speed_10m_max" in col:
        rules["wind_clipped"] = ~col["wind_speed_10m_max"].between(0.0, C.FORECAST_WIND_MAX)
    for c in _present(df, ["wind_speed_2m", ALL_SKY, CLEAR_SKY]):
        rules[f"{c}_negative"] = col[c] < 0
    if ALL_SKY in col and CLEAR_SKY in col:
        rules["all_sky_capped"] = col[ALL_SKY] > col[CLEAR_SKY]
    ranges = _present(df, [*DAILY_TEMPS, "precipitation_sum", "surface_pressure", "relative_humidity_2m", "wind_speed_10m_max", "wind_speed_2m", ALL_SKY, CLEAR_SKY])
    return [F.count(F.lit(1)).alias("n_rows"), *rule_counts(rules, ranges)]


def _series_keys(df: DataFrame, keys: Sequence[str], date_col: str):
    """Fill series per (keys, year), as the yearly files are.  The calendar
    bounds such a series (366 daily or 8,784 hourly rows per location-year), so
    one window per series is bounded whatever the data volume: no chunking,
    no summary branch, one shuffle."""
    with_year = df.withColumn("__year", F.year(date_col))
    return with_year, [*keys, "__year"], None


def _bounds_then_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str], date_col: str,
                      lo: float, hi: float, how: str) -> DataFrame:
    if not cols:
        return df
    out = df.select(*[C.null_outside(c, lo, hi).alias(c) if c in cols else F.col(c) for c in df.columns])
    base, skeys, chunk = _series_keys(out, keys, date_col)
    if how == "interpolate":
        # the reference follows interpolation with ffill + bfill; interpolation
        # already fills both edges with the nearest value and an all-null series
        # stays null either way, so that second pass is the identity and is skipped
        filled = fill.interpolate_linear(base, skeys, [date_col], cols, chunk)
    else:
        filled = fill.ffill(base, skeys, [date_col], cols, chunk)
    return filled.drop("__year")


def openmeteo_daily(df: DataFrame, as_of, keys: Sequence[str] = ("location",),
                    date_col: str = "date", counts: Observation | None = None) -> DataFrame:
    """coerce -> swap -> mean repair -> (bounds -> interpolate -> ffill/bfill)
    per temperature -> precipitation rule -> metadata."""
    keys = [k for k in keys if k in df.columns]
    nums = _present(df, [*DAILY_TEMPS, "precipitation_sum"])
    out = df.select(*[C.coerce_numeric(c).alias(c) if c in nums else F.col(c) for c in df.columns])
    out = observe(out, counts, cleaning_counts(out))
    if all(c in out.columns for c in DAILY_TEMPS):
        mn, mx = C.swap_min_max("temperature_2m_min", "temperature_2m_max")
        out = out.withColumns({"temperature_2m_min": mn, "temperature_2m_max": mx})
        out = out.withColumn("temperature_2m_mean",
                             C.repair_mean("temperature_2m_mean", "temperature_2m_min", "temperature_2m_max"))
    out = _bounds_then_fill(out, _present(out, DAILY_TEMPS), keys, date_col, *C.TEMPERATURE_BOUNDS, "interpolate")
    if "precipitation_sum" in out.columns:
        out = out.withColumn("precipitation_sum", C.precipitation_rule("precipitation_sum"))
    return add_metadata(out, "openmeteo", as_of)


def openmeteo_hourly(df: DataFrame, as_of, keys: Sequence[str] = ("location",),
                     date_col: str = "date", counts: Observation | None = None) -> DataFrame:
    """coerce -> pressure bounds -> forward fill -> metadata."""
    keys = [k for k in keys if k in df.columns]
    out = df
    if "surface_pressure" in df.columns:
        out = out.withColumn("surface_pressure", C.coerce_numeric("surface_pressure"))
        out = observe(out, counts, cleaning_counts(out))
        out = _bounds_then_fill(out, ["surface_pressure"], keys, date_col, *C.PRESSURE_BOUNDS, "ffill")
    return add_metadata(out, "openmeteo", as_of)


def nasapower_daily(long: DataFrame, as_of, keys: Sequence[str] = ("location",),
                    order_col: str | None = None, counts: Observation | None = None) -> DataFrame:
    """dedup -> pivot -> rename -> sentinel -> coerce -> temperature
    bounds/interpolate/fill -> precipitation -> cap all-sky -> clip humidity
    -> floor wind and radiation -> metadata.

    ``long`` is ``(keys, date, parameter, value)``; ``order_col`` says which
    duplicate is "first" (default: the smallest value row).
    """
    keys = [k for k in keys if k in long.columns]
    dedup = first_by_key(long, [*keys, "date", "parameter"], [order_col or "value"])
    wide = pivot_long_wide(dedup, [*keys, "date"], "parameter", "value",
                           list(POINT_SERIES_NAMES), POINT_SERIES_NAMES)
    metrics = list(POINT_SERIES_NAMES.values())
    out = wide.select(*[C.coerce_numeric(C.sentinel_to_null(c)).alias(c) if c in metrics else F.col(c)
                        for c in wide.columns])
    out = observe(out, counts, cleaning_counts(out))
    out = _bounds_then_fill(out, ["temperature_2m_mean"], keys, "date", *C.TEMPERATURE_BOUNDS, "interpolate")
    out = out.withColumns({
        "precipitation_sum": C.precipitation_rule("precipitation_sum"),
        ALL_SKY: C.cap_by(ALL_SKY, CLEAR_SKY),
        "relative_humidity_2m": C.clip("relative_humidity_2m", *C.HUMIDITY_BOUNDS),
    })
    out = out.withColumns({c: C.floor_zero(c) for c in ["wind_speed_2m", ALL_SKY, CLEAR_SKY]})
    return add_metadata(out, "nasapower", as_of)


def openmeteo_forecast(df: DataFrame, as_of, keys: Sequence[str] = ("location",),
                       date_col: str = "date", counts: Observation | None = None) -> DataFrame:
    """coerce -> max/min temperature bounds/interpolate/fill -> precipitation
    -> wind clip [0, 150] -> weather-code snap -> metadata (no swap)."""
    keys = [k for k in keys if k in df.columns]
    nums = [c for c in df.columns if c not in (*keys, date_col)]
    out = df.select(*[C.coerce_numeric(c).alias(c) if c in nums else F.col(c) for c in df.columns])
    out = observe(out, counts, cleaning_counts(out))
    out = _bounds_then_fill(out, _present(out, ["temperature_2m_max", "temperature_2m_min"]), keys, date_col,
                            *C.TEMPERATURE_BOUNDS, "interpolate")
    upd = {}
    if "precipitation_sum" in out.columns:
        upd["precipitation_sum"] = C.precipitation_rule("precipitation_sum")
    if "wind_speed_10m_max" in out.columns:
        upd["wind_speed_10m_max"] = C.clip("wind_speed_10m_max", 0.0, C.FORECAST_WIND_MAX)
    if "weather_code" in out.columns:
        upd["weather_code"] = C.nearest_code("weather_code")
    return add_metadata(out.withColumns(upd), "openmeteo", as_of)
