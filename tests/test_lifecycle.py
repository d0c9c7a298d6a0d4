"""Split preamble reader, counts taken during a write, VARIANT metrics, SQL tools."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from furrow.functions import jsonx as J
from furrow.operators import normalize, quality
from furrow.operators.search import soil_compatibility
from furrow.plans import planting, sqltools
from furrow.sources.files import read_csv_skip_preamble


def _export(path, name, n, ends="\n"):
    lines = ["latitude,longitude", "1,2", "time_key,price (TND),time", *["%d,%d.5,2024-01-%02d" % (i, i, 1 + i % 28) for i in range(n)], "", "  "]
    with open(f"{path}/{name}", "w", newline="") as f:
        f.write(ends.join(lines))


def test_preamble_reader_splits_a_file_over_tasks(spark, tmp_dir):
    _export(tmp_dir, "a.csv", 20_000)
    _export(tmp_dir, "b.csv", 3, "\r\n")
    _export(tmp_dir, "c.csv", 0)
    with open(f"{tmp_dir}/d.csv", "w") as f:
        f.write("only,a preamble")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_csv_skip_preamble(spark, tmp_dir, "k bigint, price double, time string", date_cols=["time"], renames={"price": "p"})
        tasks = df.select(F.spark_partition_id().alias("t"), "k").groupBy("t").count().collect()
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(tasks) > 4 and len(rows) == 20_003
    assert sorted(r.k for r in rows) == sorted([*range(20_000), 0, 1, 2])
    assert all(r.p == r.k + 0.5 and r.time == dt.date(2024, 1, 1 + r.k % 28) for r in rows)


def test_normaliser_counts_during_the_write_equal_the_aggregate(spark, tmp_dir):
    rows = [("s", dt.date(2024, 1, 1 + i), "%d" % t, t + 3.0, t - 3.0, p) for i, (t, p) in enumerate([(10, -1.0), (70, 0.0), (20, 900.0), (-80, 5.0), (15, None)])]
    df = spark.createDataFrame(rows, "location string, date date, temperature_2m_mean string, temperature_2m_max double, temperature_2m_min double, precipitation_sum double")
    seen = Observation("daily")
    normalize.openmeteo_daily(df, "2024-02-01", counts=seen).write.parquet(tmp_dir + "/out")
    coerced = df.withColumn("temperature_2m_mean", F.col("temperature_2m_mean").cast("double"))
    want = coerced.agg(*normalize.cleaning_counts(coerced)).first().asDict()
    assert seen.get == want
    assert want["n_temperature_2m_mean_outside"] == 2 and want["n_precipitation_negative"] == 1 and want["n_precipitation_high"] == 1 and want["n_rows"] == 5
    plain = normalize.openmeteo_daily(df, "2024-02-01")
    assert sorted(map(str, plain.collect())) == sorted(map(str, spark.read.parquet(tmp_dir + "/out").select(plain.columns).collect()))


@pytest.mark.parametrize("how", ["openmeteo_hourly", "openmeteo_forecast"])
def test_other_normalisers_count_too(spark, tmp_dir, how):
    rows = [("s", dt.datetime(2024, 1, 1, h), 800.0 + 100 * h, 200.0 * h) for h in range(4)]
    df = spark.createDataFrame(rows, "location string, date timestamp, surface_pressure double, wind_speed_10m_max double")
    df = df.drop("wind_speed_10m_max") if how == "openmeteo_hourly" else df
    seen = Observation(how)
    getattr(normalize, how)(df, "2024-02-01", counts=seen).write.parquet(f"{tmp_dir}/{how}")
    assert seen.get["n_rows"] == 4 and seen.get["n_surface_pressure_outside"] == 2
    assert how == "openmeteo_hourly" or seen.get["n_wind_clipped"] == 3


def test_reports_per_group_and_overall(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", -5.0, 2.0)], "k string, x double, y double")
    assert [tuple(r) for r in quality.nonnull_report(df, ["x", "y"]).collect()] == [(3, 2, 1, 1)]
    assert sorted(tuple(r) for r in quality.nonnull_report(df, ["x", "y"], by=["k"]).collect()) == [("a", 2, 1, 0, 1), ("b", 1, 1, 1, 0)]
    assert sorted(tuple(r) for r in quality.violation_counts(df, {"neg": F.col("x") < 0}, ["x"], by=["k"]).collect()) == [("a", 0, 1.0, 1.0), ("b", 1, -5.0, -5.0)]


def test_variant_metrics_of_mixed_types(spark, tmp_dir):
    texts = ['{"t": 1.5, "n": 3}', '{"t": "2.5"}', '{"t": "warm", "n": null}', "no json", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string").select("i", J.metrics_variant("m").alias("m"))
    df.write.parquet(tmp_dir + "/v")
    back = spark.read.parquet(tmp_dir + "/v")
    got = [tuple(r) for r in back.orderBy("i").select(J.variant_field("m", "t"), J.variant_field("m", "t", "string"), J.variant_field("m", "n", "int")).collect()]
    assert got == [(1.5, "1.5", 3), (2.5, "2.5", None), (None, "warm", None), (None, None, None), (None, None, None), (None, None, None)]
    assert "t: VARIANT" in back.where("i < 3").agg(J.discovered_schema("m")).first()[0]
    packed = spark.createDataFrame([(1, None, "x")], "a int, b double, c string").select(J.pack_metrics_variant(["a", "b", "c"]).alias("m"))
    assert tuple(packed.select(J.variant_field("m", "a", "int"), J.variant_field("m", "b"), J.variant_field("m", "c", "string")).first()) == (1, None, "x")


def _hourly(spark):
    rows = [(city, dt.datetime(y, 3, d, 12), 20.0 + (d % 5) * (city == "Tunis"), 1.0) for city in ("Tunis", "Sfax") for y in range(1990, 2021) for d in range(1, 29)]
    return spark.createDataFrame(rows, "city_name string, date_mesure timestamp_ntz, temperature_2m_mean double, precipitation_sum double")


def test_sql_tools_equal_the_dataframe_tools(spark):
    plants = spark.createDataFrame([("tomate", 18.0, 22.0, 5.0, 40.0, 4, ["Argileux", "sableux"]), ("ble", 0.0, 50.0, -5.0, 60.0, 6, [])],
                                   "nom_du_plante string, temp_min_opt double, temp_max_opt double, temp_min_abs double, temp_max_abs double, crop_cycle_min int, nature_des_sols array<string>")
    hourly = _hourly(spark)
    sqltools.register_tools(hourly, plants, ref_date="2021-01-31")
    cols = ["nom_du_plante", "month", "day", "years_analyzed", "weighted_years_analyzed", "weighted_successful_years", "success_probability_pct", "expected_rainfall_mm"]
    want = planting.optimal_planting_window(hourly, plants, "tunis", "TOMATE", ref_date="2021-01-31").select(cols)
    got = spark.sql("SELECT * FROM planting_window('tunis', 'TOMATE')")
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    assert max(r.years_analyzed for r in got.collect()) == 30  # history is bounded: the 31st year is left out
    assert spark.sql("SELECT * FROM planting_window('nowhere', '%')").count() == 0
    asked = spark.createDataFrame([("tomate", " argileux"), ("Tomate", "rocheux"), ("ble", "x"), ("rose", "x"), (None, "x"), ("ble", None)], "plant string, soil string")
    asked.createOrReplaceTempView("asked")
    answers = spark.sql("SELECT s.* FROM asked a, LATERAL soil_check(a.plant, a.soil) s")
    frame = soil_compatibility(asked, plants, plant_col="plant", soil_col="soil", exact_name=False)
    both = [sorted(((r.plant, r.soil, r.compatible, r.message) for r in x.where("plant IS NOT NULL AND soil IS NOT NULL").collect()), key=repr) for x in (answers, frame)]
    assert both[0] == both[1] and len(both[0]) == 4


def test_rain_that_is_no_number_counts_as_none(spark):
    hourly = _hourly(spark).withColumn("precipitation_sum", F.when(F.dayofmonth("date_mesure") == 3, F.lit(float("inf"))).when(F.dayofmonth("date_mesure") == 4, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    plants = spark.createDataFrame([("ble", 0.0, 50.0, -5.0, 60.0, 6)], "nom_du_plante string, temp_min_opt double, temp_max_opt double, temp_min_abs double, temp_max_abs double, crop_cycle_min int")
    out = planting.optimal_planting_window(hourly, plants, "Tunis", "ble", ref_date="2021-01-31").collect()
    assert out and all(r.expected_rainfall_mm <= 7 for r in out)
