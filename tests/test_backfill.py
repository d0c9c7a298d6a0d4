"""End-to-end yearly backfill from landed payload files."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from furrow.plans import backfill
from furrow.sources import payloads


def _land(tmp_dir):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    point = {"location": "sousse", "properties": {"parameter": {
        "T2M": {d.strftime("%Y%m%d"): (15.0 + i if i != 2 else -999.0) for i, d in enumerate(days)},
        "PRECTOTCORR": {d.strftime("%Y%m%d"): float(i) for i, d in enumerate(days)},
        "RH2M": {d.strftime("%Y%m%d"): 120.0 for d in days}}}}
    archive = {"location": "sousse", "daily": {
        "time": [d.isoformat() for d in days], "temperature_2m_mean": [10.0, 11.0, None, 13.0, 14.0, 99.0],
        "temperature_2m_max": [15.0] * 6, "temperature_2m_min": [5.0, 5.0, 5.0, 20.0, 5.0, 5.0],
        "precipitation_sum": [1.0, -1.0, 600.0, 0.0, 2.0, 3.0]},
        "hourly": {"time": [f"{d.isoformat()}T{h:02d}:00" for d in days for h in range(24)],
                   "surface_pressure": [1000.0 + h for d in days for h in range(24)]}}
    os.makedirs(tmp_dir + "/landing/point", exist_ok=True)
    os.makedirs(tmp_dir + "/landing/archive", exist_ok=True)
    with open(tmp_dir + "/landing/point/p.json", "w") as f:
        json.dump(point, f)
    with open(tmp_dir + "/landing/archive/a.json", "w") as f:
        json.dump(archive, f)


def test_yearly_backfill_end_to_end(spark, tmp_dir):
    from pyspark.sql import types as T
    _land(tmp_dir)
    point = payloads.read_point_series(spark, tmp_dir + "/landing/point",
                                       extra=T.StructType([T.StructField("location", T.StringType())]))
    long = payloads.point_series_to_long(point, keys=["location"])
    archive = (spark.read.option("multiLine", True)
               .schema("location string, daily struct<time: array<string>, temperature_2m_mean: array<double>, "
                       "temperature_2m_max: array<double>, temperature_2m_min: array<double>, "
                       "precipitation_sum: array<double>>, hourly struct<time: array<string>, "
                       "surface_pressure: array<double>>")
               .json(tmp_dir + "/landing/archive"))
    daily = payloads.arrays_to_rows(archive, "time", ["temperature_2m_mean", "temperature_2m_max",
                                                      "temperature_2m_min", "precipitation_sum"],
                                    keys=["location"], prefix="daily").withColumn("date", F.to_date("time")).drop("time")
    hourly = payloads.arrays_to_rows(archive, "time", ["surface_pressure"], keys=["location"], prefix="hourly") \
        .withColumn("date", F.to_timestamp("time").cast("timestamp_ntz")).drop("time")

    gaps = backfill.check_daily_completeness(daily, ["location"], "date", "2024-01-01", "2024-01-07")
    assert [str(r.missing_date) for r in gaps.collect()] == ["2024-01-07"]
    assert backfill.expected_hourly_rows(hourly, ["location"], "date").where("not complete").count() == 0

    paths = backfill.backfill_daily(long, daily, tmp_dir + "/normalized", "2024-02-01")
    om = {r.date.day: r for r in spark.read.parquet(paths["openmeteo"]).collect()}
    assert om[4].temperature_2m_min == 15.0 and om[4].temperature_2m_max == 20.0  # swapped
    assert om[4].temperature_2m_mean == 17.5          # 13 outside the swapped [15, 20]: midpoint
    assert om[3].temperature_2m_mean == 14.25         # null interpolated between 11 and 17.5
    assert om[6].temperature_2m_mean == 10.0          # 99 repaired to midpoint (5 + 15) / 2
    assert [om[d].precipitation_sum for d in (2, 3)] == [0.0, 0.0]
    nasa = {r.date.day: r for r in spark.read.parquet(paths["nasapower"]).collect()}
    assert nasa[3].temperature_2m_mean == 17.0 and nasa[1].relative_humidity_2m == 100.0

    out = backfill.backfill_hourly(hourly, paths["nasapower"], tmp_dir + "/facts", "2024-02-01")
    facts = spark.read.parquet(out)
    assert facts.count() == 144 and facts.select("yyyymm").distinct().first()[0] == 202401
    r = facts.where(F.col("date") == "2024-01-03 05:00:00").first()
    assert r.surface_pressure == 1005.0 and r.temperature_2m_mean == 17.0
