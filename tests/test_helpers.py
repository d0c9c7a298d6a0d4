"""Smaller helpers: CSV reader and export, prefix filter, counts, JSON, Kc values, quality reports."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from furrow.functions import jsonx
from furrow.operators import quality, search
from furrow.plans import catalog
from furrow.sinks import partitioned
from furrow.sources import files


def test_read_csv_and_export(spark, tmp_dir):
    p = os.path.join(tmp_dir, "kc.csv")
    with open(p, "w") as f:
        f.write("category,crop,variant,kc_ini,kc_mid,kc_end,max_height_m\n"
                "Small Vegetables,Broccoli,,,1.05,0.95,0.3\nLegumes,Beans,green,0.50,1.05,0.90,0.4\n"
                "Legumes,Peas,,0.5-0.6,1.15,1.10,0.5\n")
    kc = files.read_csv(spark, p, "category string, crop string, variant string, kc_ini string, "
                                  "kc_mid string, kc_end string, max_height_m string")
    typed = {r.crop: r for r in catalog.kc_values(kc).collect()}
    assert typed["Broccoli"].kc_ini_lo is None and typed["Peas"].kc_ini_lo == 0.5
    assert [r.crop for r in search.search_range(kc, "kc_ini", 0.4, 0.5).orderBy("crop").collect()] == ["Beans", "Peas"]
    out = os.path.join(tmp_dir, "out")
    partitioned.export(kc, out + "/csv", "csv")
    partitioned.export(kc, out + "/json", "json")
    assert spark.read.option("header", True).csv(out + "/csv").count() == 3
    assert spark.read.json(out + "/json").count() == 3
    with pytest.raises(ValueError):
        partitioned.export(kc, out + "/x", "xml")


def test_prefix_and_counts(spark):
    cat = spark.createDataFrame([("TN-1", "INRAT", "u"), ("TN-2", "INRAT", ""), ("FR-1", "INRAE", None),
                                 ("TN-3", "ONAGRI", "v")], "id string, creator string, download_url string")
    assert search.filter_prefix(cat, "id", "TN").count() == 3
    top = catalog.count_top(cat, "creator", 2).collect()
    assert [(r.creator, r.n) for r in top] == [("INRAT", 2), ("INRAE", 1)]
    s = catalog.catalog_summary(cat.withColumn("country", catalog.country_of("id"))).first()
    assert (s.n_records, s.n_with_url, s.n_countries, s.n_creators) == (4, 2, 2, 3)


def test_json_helpers(spark):
    df = spark.createDataFrame([(1, 2.5, None)], "id int, t double, p double")
    r = df.select(jsonx.pack_metrics(["t", "p"]).alias("j"), jsonx.metric_map(["t", "p"]).alias("m")).first()
    assert r.j == '{"t":2.5}' and r.m == {"t": 2.5}
    assert df.select(jsonx.json_field(jsonx.pack_metrics(["t"]), "t")).first()[0] == 2.5


def test_quality_reports(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, d), "T2M") for d in (1, 2, 4)]
                               + [("s", dt.date(2024, 1, 1), "RH2M")], "loc string, date date, parameter string")
    gaps = [str(r.missing_date) for r in quality.missing_dates(df, ["loc"], "date").collect()]
    assert gaps == ["2024-01-03"]
    fixed = quality.missing_dates(df, ["loc"], "date", "2023-12-31", "2024-01-04")
    assert sorted(str(r.missing_date) for r in fixed.collect()) == ["2023-12-31", "2024-01-03"]
    miss = quality.missing_parameters(df, ["loc"], "parameter", ["T2M", "RH2M", "WS2M"]).collect()
    assert [r.parameter for r in miss] == ["WS2M"]
    rep = quality.completeness_report(df, ["loc"], "date", 4, param_col="parameter", n_params=2).first()
    assert rep.n_rows == 4 and rep.expected_rows == 8 and not rep.complete
    with pytest.raises(quality.DataQualityError):
        quality.assert_complete(quality.completeness_report(df, ["loc"], "date", 4, n_params=2))
    fc = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None), (dt.date(2024, 1, 2), None, None)],
                               "date date, a double, b double")
    with pytest.raises(quality.DataQualityError):
        quality.validate_forecast(fc, ["date", "a", "b"], ["a", "b"])
    with pytest.raises(quality.DataQualityError):
        quality.validate_forecast(fc, ["date", "c"], ["a"])
    ok = quality.validate_forecast(fc.where("a is not null"), ["date"], ["a", "b"]).first()
    assert ok.nonnull_a == 1 and ok.all_null_rows == 0


def test_replace_and_drop_tables(spark, tmp_dir):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS furrow_t LOCATION '{tmp_dir}/db'")
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    partitioned.replace_table(df, "furrow_t.src")
    partitioned.replace_table(df.union(df), "furrow_t.src")
    assert spark.table("furrow_t.src").count() == 2
    with pytest.raises(PermissionError):
        partitioned.drop_all_tables(spark, "furrow_t")
    assert partitioned.drop_all_tables(spark, "furrow_t", confirm=True) == ["src"]
    assert spark.catalog.listTables("furrow_t") == []
    spark.sql("DROP DATABASE furrow_t")


def test_pack_metrics_upsert(spark):
    from furrow.sinks import upsert
    cur = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 1, 1), '{"t":1.0}')],
                                "loc int, date date, extraction_date date, metrics string")
    inc = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 1, 2), 2.0, None),
                                 (2, dt.date(2024, 1, 1), dt.date(2024, 1, 2), None, 3.0)],
                                "loc int, date date, extraction_date date, t double, p double")
    out = {r.loc: r.metrics for r in upsert.pack_metrics_upsert(cur, inc, ["loc", "date"], ["t", "p"]).collect()}
    assert out == {1: '{"t":2.0}', 2: '{"p":3.0}'}


def test_plant_requirement_report(spark):
    from furrow.sources.reference import plants
    rep = {r.nom_du_plante: r for r in quality.plant_requirement_report(plants(spark)).collect()}
    assert rep["Oignon"].seasonal_precipitation and not rep["Tomate"].seasonal_precipitation
    assert not any(r.inverted_optimum or r.inverted_cycle or r.optimum_outside_limits for r in rep.values())


def test_partition_reader_absent_and_strict(spark, tmp_dir):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("t", T.DoubleType())])
    empty = files.read_partition(spark, tmp_dir + "/none", schema=schema, year=2024)
    assert empty.count() == 0 and empty.columns == ["date", "t"]
    with pytest.raises(files.MissingPartition):
        files.read_partition(spark, tmp_dir + "/none", schema=schema, strict=True, year=2024)
    df = spark.createDataFrame([(dt.date(2023, 5, 1), 1.0), (dt.date(2024, 5, 1), 2.0)], schema)
    partitioned.write_partitioned(df, tmp_dir + "/y", "date", ("year",))
    assert files.read_partition(spark, tmp_dir + "/y", strict=True, year=2024).count() == 1
    with pytest.raises(files.MissingPartition):
        files.read_partition(spark, tmp_dir + "/y", strict=True, year=2022)
    years = files.read_years(spark, tmp_dir + "/y", [2023, 2024], ts_col="date")
    assert years.count() == 2
    stamped = files.stamp_source(df.withColumn("extraction_date", F.lit(None).cast("date")), "openmeteo",
                                 "2024-06-01").first()
    assert stamped.source == "openmeteo" and str(stamped.extraction_date) == "2024-06-01"
