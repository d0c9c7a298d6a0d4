"""Long/wide reshaping (ops 3.1, 3.2, 3.16, 3.17, 4.2)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Point-series parameter codes and their canonical metric names.
POINT_SERIES_NAMES = {
    "T2M": "temperature_2m_mean",
    "PRECTOTCORR": "precipitation_sum",
    "RH2M": "relative_humidity_2m",
    "WS2M": "wind_speed_2m",
    "ALLSKY_SFC_SW_DWN": "all_sky_surface_shortwave_radiation_downward",
    "CLRSKY_SFC_SW_DWN": "clear_sky_surface_shortwave_radiation_downward",
}


def pivot_long_wide(df: DataFrame, index: Sequence[str], key: str, value: str,
                    keys: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Long ``(index..., key, value)`` to one column per key (op 3.1).

    ``keys`` is the explicit value list (no extra job to discover it).  Input
    must be unique on ``(index, key)`` (dedup first, as the reference's pivot
    raises otherwise); ``rename`` maps codes to canonical names (op 3.2).
    """
    wide = df.groupBy(*index).pivot(key, list(keys)).agg(F.first(value))
    if rename:
        wide = wide.withColumnsRenamed({k: v for k, v in rename.items() if k in keys})
    return wide


def unpivot_wide(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long (op 3.17)."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names fully matching a regex (op 3.16), e.g. ``Y\\d{4}`` / ``Y\\d{4}F``."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.fullmatch(c)]


def unpivot_value_flag(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                       flag_of: Mapping[str, str], var_name: str = "Year",
                       key_of: Mapping[str, object] | None = None) -> DataFrame:
    """Unpivot value columns and their flag columns together (ops 3.17, 4.2).

    The reference unpivots values and flags separately and joins them back
    on all id columns plus the year; one unpivot of ``struct(value, flag)``
    gives the same rows without the join (and its shuffle).
    ``key_of`` maps a value column to the label written in ``var_name``
    (default: the column name).
    """
    packed = df.select(*ids, *[F.struct(F.col(c).alias("Value"),
                                        (F.col(flag_of[c]) if c in flag_of else F.lit(None).cast("string")).alias("Flag"))
                               .alias(c) for c in value_cols])
    long = packed.unpivot(list(ids), list(value_cols), "__var", "__vf")
    label = F.col("__var")
    if key_of:
        m = F.create_map(*[x for c in value_cols for x in (F.lit(c), F.lit(key_of.get(c, c)))])
        label = m[F.col("__var")]
    return long.select(*ids, label.alias(var_name), F.col("__vf.Value").alias("Value"),
                       F.col("__vf.Flag").alias("Flag"))


def year_from_header(c, prefix: str = "Y") -> F.Column:
    """``Y1991`` -> 1991."""
    col = F.col(c) if isinstance(c, str) else c
    return F.substring(col, len(prefix) + 1, 4).cast("int")
