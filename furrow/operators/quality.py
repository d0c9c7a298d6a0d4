"""Completeness, validation and rule-violation reports (ops 3.19-3.21, 4.6, 5.8, 5.15, 8.2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    pass


def expected_days(bounds: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
                  step_hours: int | None = None, out: str = "expected") -> DataFrame:
    """One row per expected day (or ``step_hours`` step) between per-key bounds.
    Calendar-bounded: a key spans at most days x (24 / step) rows."""
    if step_hours:
        seq = F.sequence(F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz"),
                         F.expr(f"INTERVAL {int(step_hours)} HOURS"))
    else:
        seq = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))
    return bounds.select(*keys, F.explode(seq).alias(out))


def missing_dates(df: DataFrame, keys: Sequence[str], date_col: str,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Expected days minus present days, per key (ops 3.19, 4.6, 8.2).

    Bounds default to each key's own first and last day.  Result: keys,
    ``missing_date``.
    """
    keys = list(keys)
    present = df.select(*keys, F.to_date(date_col).alias("d"))
    if start is None or end is None:
        bounds = present.groupBy(*keys).agg(F.min("d").alias("start"), F.max("d").alias("end"))
    else:
        base = present.select(*keys).distinct() if keys else df.sparkSession.range(1)
        bounds = base.select(*keys, F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    exp = expected_days(bounds, keys, out="missing_date")
    have = present.select(*keys, F.col("d").alias("missing_date")).distinct()
    return exp.join(have, [*keys, "missing_date"], "left_anti")


def missing_parameters(df: DataFrame, keys: Sequence[str], param_col: str,
                       expected: Sequence[str]) -> DataFrame:
    """Expected parameters absent for a key (op 3.19)."""
    keys = list(keys)
    present = df.select(*keys, param_col).distinct()
    exp = df.select(*keys).distinct().withColumn(param_col, F.explode(F.array(*[F.lit(p) for p in expected])))
    return exp.join(present, [*keys, param_col], "left_anti")


def completeness_report(df: DataFrame, keys: Sequence[str], date_col: str, n_expected_days: int,
                        per_day: int = 1, param_col: str | None = None,
                        n_params: int | None = None) -> DataFrame:
    """Row-count check per key: days x parameters (long daily), days (wide
    daily) or days x 24 (hourly)."""
    expect = n_expected_days * per_day * (n_params or 1)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.to_date(date_col)).alias("n_days")]
    if param_col:
        aggs.append(F.countDistinct(param_col).alias("n_params"))
    rep = df.groupBy(*keys).agg(*aggs)
    return rep.withColumn("expected_rows", F.lit(expect).cast("long")).withColumn(
        "complete", F.col("n_rows") == F.col("expected_rows"))


def assert_complete(report: DataFrame) -> None:
    """Strict mode: raise when any key is incomplete (one small aggregate)."""
    bad = report.where(~F.col("complete")).limit(5).collect()
    if bad:
        raise DataQualityError(f"incomplete series: {[r.asDict() for r in bad]}")


def nonnull_counts(metrics: Sequence[str]) -> list[Column]:
    """Aggregates: total rows, non-null count per metric, rows with every metric null."""
    all_null = F.coalesce(*[F.col(c) for c in metrics]).isNull() if metrics else F.lit(True)
    return [F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(f"nonnull_{c}") for c in metrics],
            F.count_if(all_null).alias("all_null_rows")]


def nonnull_report(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``nonnull_counts`` of all rows, or one row per ``by`` (op 5.8)."""
    return df.groupBy(*by).agg(*nonnull_counts(metrics))


def validate_forecast(df: DataFrame, required: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Forecast checks (op 3.20): required columns, non-empty, no all-null
    metric row.  Returns the non-null report; raises on failure."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise DataQualityError(f"missing columns: {missing}")
    rep = nonnull_report(df, metrics)
    r = rep.first()
    if r["n_rows"] == 0:
        raise DataQualityError("empty forecast")
    if r["all_null_rows"] > 0:
        raise DataQualityError(f"{r['all_null_rows']} forecast rows have every metric null")
    return rep


def rule_counts(rules: Mapping[str, Column], ranges: Sequence[str] = ()) -> list[Column]:
    """Aggregates: rows breaking each rule, and min/max of ``ranges``."""
    return [*[F.count_if(c).alias(f"n_{name}") for name, c in rules.items()],
            *[x for c in ranges for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]]


def violation_counts(df: DataFrame, rules: Mapping[str, Column], ranges: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """``rule_counts`` before cleaning, of all rows or one row per ``by`` (op 5.15)."""
    return df.groupBy(*by).agg(*rule_counts(rules, ranges))


def observe(df: DataFrame, observation: Observation | None, aggregates: Sequence[Column]) -> DataFrame:
    """``df`` unchanged, its ``aggregates`` counted while whatever reads it runs,
    as a write does: no pass of their own.  ``observation.get`` brings them after
    the first action."""
    return df if observation is None or not aggregates else df.observe(observation, *aggregates)


def year_batches(df: DataFrame, date_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Split a date set into per-year (first, last) day batches (op 3.21)."""
    d = F.to_date(date_col)
    return (df.select(*keys, d.alias("d")).groupBy(*keys, F.year("d").alias("year"))
            .agg(F.min("d").alias("first_day"), F.max("d").alias("last_day")))


def plant_requirement_report(plants: DataFrame, daily_max_mm: float = 100.0) -> DataFrame:
    """Flag plant rows whose optimal precipitation looks like a seasonal
    figure rather than a daily one (e.g. 350-550 mm against 1-5 mm elsewhere),
    and rows whose temperature bands are inverted.  Data is kept as given."""
    return plants.select(
        "nom_du_plante",
        (F.col("precipitation_max_opt") > daily_max_mm).alias("seasonal_precipitation"),
        (F.col("temp_min_opt") > F.col("temp_max_opt")).alias("inverted_optimum"),
        ((F.col("temp_min_abs") > F.col("temp_min_opt")) | (F.col("temp_max_abs") < F.col("temp_max_opt")))
        .alias("optimum_outside_limits"),
        (F.col("crop_cycle_min") > F.col("crop_cycle_max")).alias("inverted_cycle"))
