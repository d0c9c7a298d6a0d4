"""Physical cleaning rules as Column expressions (ops 3.3-3.13, 9.10).

All rules are null-preserving: a null input stays null unless the rule says
otherwise.  NaN is turned into null first (``nan_to_null``), because Spark
orders NaN above every number (``NaN > 5`` is true) while the reference's
pandas masks treat NaN as missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions._util import as_col

# Physical bounds and caps used by the normalisers.
TEMPERATURE_BOUNDS = (-50.0, 60.0)
PRESSURE_BOUNDS = (870.0, 1090.0)
PRECIP_MAX = 500.0
HUMIDITY_BOUNDS = (0.0, 100.0)
FORECAST_WIND_MAX = 150.0
SENTINEL = -999

# The valid weather codes a forecast code is snapped to.
WEATHER_CODES = [0, 1, 2, 3, 45, 48, 51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75,
                 77, 80, 81, 82, 85, 86, 95, 96, 99]


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c, sentinel: float = SENTINEL) -> Column:
    """``-999`` (the point-series "missing" marker) to null (op 3.3)."""
    c = as_col(c)
    return F.when(c != F.lit(sentinel), c)


def coerce_numeric(c) -> Column:
    """Text or number to DOUBLE; unparsable text and NaN become null (op 3.4)."""
    c = as_col(c)
    text = F.trim(c.cast("string"))
    return nan_to_null(F.when(~text.rlike("[dDfF]$") | F.lower(text).rlike("inf$"), text.try_cast("double")))


def null_outside(c, lo: float, hi: float) -> Column:
    """Keep values in ``[lo, hi]`` (inclusive); everything else is null (op 3.5)."""
    c = as_col(c)
    return F.when(c.between(F.lit(lo), F.lit(hi)), c)


def swap_min_max(mn, mx) -> tuple[Column, Column]:
    """(min, max) swapped where min > max (op 3.6); both read the originals."""
    mn, mx = as_col(mn), as_col(mx)
    bad = mn > mx
    return F.when(bad, mx).otherwise(mn), F.when(bad, mn).otherwise(mx)


def repair_mean(mean, mn, mx) -> Column:
    """Mean outside [min, max] replaced by the midpoint (op 3.7); run after the swap."""
    mean, mn, mx = as_col(mean), as_col(mn), as_col(mx)
    return F.when((mean < mn) | (mean > mx), (mn + mx) / 2).otherwise(mean)


def precipitation_rule(c, hi: float = PRECIP_MAX) -> Column:
    """Negative or above ``hi`` becomes 0 (not capped) (op 3.8)."""
    c = as_col(c)
    return F.when((c < 0) | (c > F.lit(hi)), F.lit(0.0)).otherwise(c)


def cap_by(c, cap) -> Column:
    """``c`` capped at another column (op 3.9); a null ``c`` stays null and a
    null cap leaves ``c`` unchanged (``least`` would skip the null)."""
    c, cap = as_col(c), as_col(cap)
    return F.when(c > cap, cap).otherwise(c)


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; null kept (ops 3.10, 3.12)."""
    c = as_col(c)
    out = None
    if lo is not None:
        out = F.when(c < F.lit(lo), F.lit(float(lo)))
    if hi is not None:
        out = F.when(c > F.lit(hi), F.lit(float(hi))) if out is None else out.when(c > F.lit(hi), F.lit(float(hi)))
    return c if out is None else out.otherwise(c)


def floor_zero(c) -> Column:
    """Negative values to 0 (op 3.11)."""
    c = as_col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def nearest_code(c, codes: Iterable[int] = WEATHER_CODES) -> Column:
    """Round half to even, then snap to the nearest valid code; on a tie the
    lower code wins; null stays null (op 3.13).

    Between two consecutive sorted codes the nearest one changes at their
    midpoint, so the snap is a CASE chain on the midpoints (``<=`` sends a
    value exactly on a midpoint to the lower code); it stays in generated code.
    """
    r = F.bround(as_col(c).cast("double"), 0)
    cs = sorted(int(x) for x in codes)
    out = None
    for lo, hi in zip(cs, cs[1:]):
        cond = r <= F.lit((lo + hi) / 2.0)
        out = F.when(cond, F.lit(float(lo))) if out is None else out.when(cond, F.lit(float(lo)))
    out = F.lit(float(cs[0])) if out is None else out.otherwise(F.lit(float(cs[-1])))
    return F.when(r.isNotNull() & ~F.isnan(r), out)
