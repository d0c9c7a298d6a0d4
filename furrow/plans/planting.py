"""Optimal planting window (ops 5.1-5.3, 6.1-6.2, 7.1, 4.4, 9.11-9.13).

One lazy plan for every (location, plant) pair at once:

    hourly facts --(partial agg, shuffle on location/day)--> daily rollup
    requests(location, plant) join broadcast(plants) by name   (bounded dim)
    daily rollup join requests by location --> daily flags
    flags --(one sort per location/plant)--> forward windows
    windows --> success + recency weight --> (month, day) aggregate --> top-k

Forward sums use prefix sums and ``lead``: the frame ``CURRENT ROW AND n
FOLLOWING`` equals ``cum[i+n] - cum[i-1]``; past the partition end the frame
is truncated, which ``coalesce(lead(...), partition total)`` reproduces.  A
``lead`` costs O(1) per row, where a sliding frame re-aggregates n rows, and
it lets plants with different cycle lengths share one window pass: one
``lead`` per distinct cycle length (a handful), chosen per row by ``when``.
Rain is summed in fixed point (micro-units as BIGINT), so the difference of
prefix sums is exact.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Defaults of the reference planting query.
DEFAULT_REF_DATE = "2026-01-31"
DEFAULT_YEARS_BACK = 30
DEFAULT_RAIN_CAP_MM = 1500.0
GERM_ROWS = 7            # CURRENT ROW AND 6 FOLLOWING
GERM_MIN_DAYS = 5
PERFECT_SHARE = 0.4
RECENT_YEARS = 5
MIN_YEARS = 5
TOP_K = 30
DAYTIME_HOURS = (6, 18)

_MICRO = 1_000_000
#: a day's rain that is no number, infinite or beyond this many mm counts as unknown, so as none
MAX_RAIN_MM = 1e9


def daily_rollup(hourly: DataFrame, ts_col: str, temp_col: str, rain_col: str,
                 loc_cols: Sequence[str] = (), daytime_hours: tuple[int, int] | None = DAYTIME_HOURS,
                 rain: str = "sum") -> DataFrame:
    """Hourly to daily rollup (op 5.1).

    ``daytime_temp_avg`` averages only hours in ``daytime_hours`` (inclusive);
    ``None`` averages every row.  ``rain='sum'`` is the reference behaviour
    (daily rain repeated on 24 hourly rows is summed); ``'max'`` takes one value per day.
    """
    ts = F.col(ts_col)
    t = F.col(temp_col)
    if daytime_hours is None:
        avg_t = F.avg(t)
    else:
        lo, hi = daytime_hours
        avg_t = F.avg(F.when(F.hour(ts).between(lo, hi), t))
    rain_agg = F.sum(rain_col) if rain == "sum" else F.max(rain_col)
    return (hourly.groupBy(*loc_cols, F.to_date(ts).alias("day_date"))
            .agg(avg_t.alias("daytime_temp_avg"),
                 F.min(t).alias("daily_temp_min"),
                 F.max(t).alias("daily_temp_max"),
                 rain_agg.alias("daily_rain")))


def history_filter(hourly: DataFrame, ts_col: str, ref_date: str = DEFAULT_REF_DATE,
                   years_back: int = DEFAULT_YEARS_BACK, city_col: str | None = None,
                   city: str | None = None) -> DataFrame:
    """``city ILIKE :city AND ts >= ref_date - years`` as plain comparisons so
    they reach the scan (and partition pruning on a year/date column)."""
    ref = _dt.date.fromisoformat(ref_date)
    try:
        start = ref.replace(year=ref.year - years_back)
    except ValueError:  # Feb 29
        start = ref.replace(year=ref.year - years_back, day=28)
    out = hourly.where(F.col(ts_col) >= F.lit(_dt.datetime.combine(start, _dt.time())))
    if city_col and city is not None:
        out = out.where(F.col(city_col).ilike(city))
    return out


def _forward_sum(cum: Column, x: Column, total: Column, lead_cum: Column) -> Column:
    """Sum of x over rows [i, i+n] from prefix sums."""
    return F.coalesce(lead_cum, total) - cum + x


def planting_windows(daily: DataFrame, plants: DataFrame, requests: DataFrame,
                     loc_cols: Sequence[str] = ("location",), ref_date: str = DEFAULT_REF_DATE,
                     rain_cap: float = DEFAULT_RAIN_CAP_MM,
                     germ_rows: int = GERM_ROWS, germ_min: int = GERM_MIN_DAYS,
                     perfect_share: float = PERFECT_SHARE, recent_years: int = RECENT_YEARS,
                     min_years: int = MIN_YEARS, top_k: int | None = TOP_K) -> DataFrame:
    """Best planting start dates per (location, plant).

    ``daily`` has ``loc_cols``, ``day_date``, ``daytime_temp_avg``,
    ``daily_temp_min``, ``daily_temp_max``, ``daily_rain``.  ``plants`` has
    ``nom_du_plante``, ``temp_min_opt``, ``temp_max_opt``, ``temp_min_abs``,
    ``temp_max_abs``, ``crop_cycle_min``.  ``requests`` holds the
    (``loc_cols``, ``nom_du_plante``) pairs to answer; both joins are equi-joins
    (requests to plants by name, daily rows to requests by location).
    Output: loc_cols, nom_du_plante, month, day, years_analyzed,
    weighted_years_analyzed, weighted_successful_years,
    success_probability_pct, expected_rainfall_mm.
    """
    ref = _dt.date.fromisoformat(ref_date)
    plant_cols = ["nom_du_plante", "temp_min_opt", "temp_max_opt", "temp_min_abs",
                  "temp_max_abs", "crop_cycle_min"]
    dim = plants.select(*plant_cols)
    # The distinct cycle lengths (whole days of a season) drive one lead each.
    cycles = dim.agg(F.array_sort(F.collect_set("crop_cycle_min")).alias("cycles")).first()["cycles"]
    req = requests.select(*loc_cols, "nom_du_plante").distinct().join(dim, "nom_du_plante")

    a = F.col("daytime_temp_avg")
    flags = (daily.join(req, list(loc_cols))
             .select(*loc_cols, "nom_du_plante", "crop_cycle_min", "day_date",
                     F.when((a >= F.col("temp_min_opt")) & (a <= F.col("temp_max_opt")), 1)
                      .otherwise(0).alias("p"),
                     F.when((F.col("daily_temp_min") < F.col("temp_min_abs"))
                            | (F.col("daily_temp_max") > F.col("temp_max_abs")), 1)
                      .otherwise(0).alias("x"),
                     F.coalesce(F.round(F.when(F.abs("daily_rain") < MAX_RAIN_MM, F.col("daily_rain")) * _MICRO).cast("bigint"), F.lit(0)).alias("r")))

    keys = [*loc_cols, "nom_du_plante"]
    w = Window.partitionBy(*keys).orderBy("day_date")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = F.struct(F.sum("p").over(run).alias("p"), F.sum("x").over(run).alias("x"),
                   F.sum("r").over(run).alias("r"))
    tot = F.struct(F.sum("p").over(whole).alias("p"), F.sum("x").over(whole).alias("x"),
                   F.sum("r").over(whole).alias("r"))
    with_cum = flags.select("*", cum.alias("cum"), tot.alias("tot"))

    cyc = F.col("crop_cycle_min")
    lead_cycle = None
    for n in cycles:
        expr = F.lead("cum", n).over(w)
        lead_cycle = F.when(cyc == n, expr) if lead_cycle is None else lead_cycle.when(cyc == n, expr)
    lead_germ = F.lead("cum.p", germ_rows - 1).over(w)
    wins = with_cum.select(
        *keys, "crop_cycle_min", "day_date", "p", "x", "r", "cum", "tot",
        lead_germ.alias("lead_germ"), lead_cycle.alias("lead_cyc"))

    germ = _forward_sum(F.col("cum.p"), F.col("p"), F.col("tot.p"), F.col("lead_germ"))
    perfect = _forward_sum(F.col("cum.p"), F.col("p"), F.col("tot.p"), F.col("lead_cyc.p"))
    fatal = _forward_sum(F.col("cum.x"), F.col("x"), F.col("tot.x"), F.col("lead_cyc.x"))
    rain = _forward_sum(F.col("cum.r"), F.col("r"), F.col("tot.r"), F.col("lead_cyc.r")) / F.lit(float(_MICRO))
    age = F.lit(ref.year) - F.year("day_date")
    success = ((germ >= germ_min) & (perfect >= cyc * perfect_share) & (fatal == 0)
               & (rain <= rain_cap)).cast("int")
    weight = F.when(age <= recent_years, F.lit(1.0)).otherwise(F.lit(1.0) / F.sqrt(age.cast("double")))
    scored = (wins
              # predicate on the window output: stays above the forward-looking window
              .where(F.col("day_date") <= F.date_sub(F.lit(ref), cyc))
              .select(*keys, F.month("day_date").alias("month"), F.dayofmonth("day_date").alias("day"),
                      success.alias("is_success"), rain.alias("cycle_total_rain"), weight.alias("w")))

    sw = F.sum("w")
    ssw = F.sum(F.col("is_success") * F.col("w"))
    agg = (scored.groupBy(*keys, "month", "day")
           .agg(F.count(F.lit(1)).alias("years_analyzed"),
                F.round(sw, 2).alias("weighted_years_analyzed"),
                F.round(ssw, 2).alias("weighted_successful_years"),
                F.round(ssw / sw * 100, 1).alias("success_probability_pct"),
                F.round(F.sum(F.col("cycle_total_rain") * F.col("w")) / sw, 1).alias("expected_rainfall_mm"))
           .where(F.col("years_analyzed") >= min_years))
    if top_k is None:
        return agg
    # at most 366 (month, day) rows per key: a bounded partition per window
    rank_w = Window.partitionBy(*keys).orderBy(
        F.col("success_probability_pct").desc(), F.col("weighted_successful_years").desc(),
        F.col("month"), F.col("day"))
    return (agg.withColumn("rank", F.row_number().over(rank_w))
            .where(F.col("rank") <= top_k).drop("rank"))


def optimal_planting_window(hourly: DataFrame, plants: DataFrame, city: str, plant: str,
                            ts_col: str = "date_mesure", temp_col: str = "temperature_2m_mean",
                            rain_col: str = "precipitation_sum", city_col: str = "city_name",
                            ref_date: str = DEFAULT_REF_DATE, years_back: int = DEFAULT_YEARS_BACK,
                            rain: str = "sum", **kwargs) -> DataFrame:
    """The reference tool: one city (ILIKE) and one plant (ILIKE) on an hourly fact table."""
    hist = history_filter(hourly, ts_col, ref_date, years_back, city_col=city_col, city=city)
    hist = hist.withColumn(city_col, F.lit(city))
    daily = daily_rollup(hist, ts_col, temp_col, rain_col, [city_col], rain=rain)
    chosen = plants.where(F.col("nom_du_plante").ilike(plant))
    requests = chosen.select(F.lit(city).alias(city_col), "nom_du_plante")
    return planting_windows(daily, chosen, requests, [city_col], ref_date=ref_date, **kwargs)


def all_planting_windows(hourly: DataFrame, plants: DataFrame, requests: DataFrame,
                         ts_col: str = "date_mesure", temp_col: str = "temperature_2m_mean",
                         rain_col: str = "precipitation_sum", loc_cols: Sequence[str] = ("city_name",),
                         ref_date: str = DEFAULT_REF_DATE, years_back: int = DEFAULT_YEARS_BACK,
                         rain: str = "sum", **kwargs) -> DataFrame:
    """Batch form: every requested (location, plant) pair in one plan."""
    hist = history_filter(hourly, ts_col, ref_date, years_back)
    daily = daily_rollup(hist, ts_col, temp_col, rain_col, loc_cols, rain=rain)
    return planting_windows(daily, plants, requests, loc_cols, ref_date=ref_date, **kwargs)
