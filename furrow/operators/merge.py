"""Grain merge and source-priority merge (ops 3.18, 4.1, 5.9, 8.3)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA = ("date", "source", "extraction_date")


def metric_columns(df: DataFrame, exclude: Sequence[str] = METADATA) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]


def spread_daily_on_hourly(hourly: DataFrame, daily: DataFrame, keys: Sequence[str] = (),
                           ts_col: str = "date", day_col: str = "date",
                           extraction_col: str = "extraction_date", salt_buckets: int = 0) -> DataFrame:
    """Daily metrics repeated on every hourly row of the same day (op 4.1).

    Left equi-join on ``keys + day``; ``extraction_date`` becomes the row-wise
    latest of both sides (``greatest`` skips nulls, op 5.9).  The daily side
    is one row per key-day, so no row multiplies when it is deduplicated
    first; the join strategy is left to the optimizer (AQE turns it into a
    broadcast at run time when the daily side proves small, and splits skewed
    partitions).  ``salt_buckets`` salts the join explicitly for a hot
    location-day when neither applies.
    """
    keys = list(keys)
    h_metrics = metric_columns(hourly, (*METADATA, *keys, ts_col))
    d_metrics = [c for c in metric_columns(daily, (*METADATA, *keys, day_col)) if c not in h_metrics]
    h = hourly.select(*keys, ts_col, *h_metrics,
                      F.col(extraction_col).alias("__h_ext"),
                      F.to_date(ts_col).alias("__day"))
    d = daily.select(*keys, F.to_date(day_col).alias("__day"), *d_metrics,
                     F.col(extraction_col).alias("__d_ext"))
    if salt_buckets:
        from furrow.operators.skew import salted_join
        out = salted_join(h, d, [*keys, "__day"], "left", salt_buckets)
    else:
        out = h.join(d, [*keys, "__day"], "left")
    return out.select(*keys, ts_col, *h_metrics, *d_metrics,
                      F.greatest("__h_ext", "__d_ext").alias(extraction_col))


def source_priority_merge(frames: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = (),
                          date_col: str = "date", how: str = "full_outer",
                          extraction_col: str = "extraction_date", mode: str = "drop") -> DataFrame:
    """Merge any number of per-source frames; a metric already supplied by a
    higher-priority source (earlier in ``frames``) is dropped from later ones (op 3.18).

    The frames are united under their rank and met by one aggregate on ``keys +
    date``: rows move once, however many sources there are, and are combined in
    the tasks first.  Metric name sets are schema metadata (op 8.3 is a set
    intersection of column names); ``extraction_date`` is the latest of a
    key's sources (op 5.9).  ``mode="coalesce"`` keeps the priority but fills a
    metric that the higher-priority source lacks on a date from the next source.
    ``how`` keeps the keys of any source, of the first (``left``) or of all
    (``inner``).

    A source holds one row per key and date (the normalisers see to it); of
    repeated ones each metric is the smallest non-null value.  Null keys are
    one key.
    """
    if mode not in ("drop", "coalesce") or how not in ("full_outer", "left", "inner"):
        raise ValueError((mode, how))
    on = [*keys, date_col]
    owners: dict[str, list[int]] = {}
    for i, (_, df) in enumerate(frames):
        for c in metric_columns(df, (*METADATA, *on)):
            if mode == "coalesce" or c not in owners:
                owners.setdefault(c, []).append(i)
    parts = [df.select(*on, *[c for c, o in owners.items() if i in o], F.col(extraction_col).alias("__ext"), F.lit(i).alias("__rank"))
             for i, (_, df) in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def best(c: str) -> Column:
        v = F.col(f"`{c}`")
        if len(owners[c]) == 1:
            return F.min(v).alias(c)
        return F.min(F.when(v.isNotNull(), F.struct(F.col("__rank"), v.alias("v"))))["v"].alias(c)

    out = both.groupBy(*on).agg(*[best(c) for c in owners], F.max("__ext").alias(extraction_col),
                                   F.min("__rank").alias("__first"), F.count_distinct("__rank").alias("__n"))
    keep = {"left": F.col("__first") == 0, "inner": F.col("__n") == len(frames)}.get(how)
    return (out if keep is None else out.where(keep)).drop("__first", "__n")
