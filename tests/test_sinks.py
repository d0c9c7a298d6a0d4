"""Partition round trips, idempotent upserts, schema alignment, keys (ops 2.x, 5.4, 12.x)."""

import datetime as dt

from pyspark.sql import functions as F

from furrow.operators import keys
from furrow.sinks import align, partitioned, upsert


def _days(spark, days, v):
    return spark.createDataFrame([(dt.date(2024, 1, d), "sousse", float(v)) for d in days],
                                 "date date, location string, t double")


def test_dynamic_overwrite_keeps_other_days(spark, tmp_dir):
    path = tmp_dir + "/daily"
    partitioned.write_partitioned(_days(spark, [1, 2, 3], 1), path, "date")
    partitioned.write_partitioned(_days(spark, [2], 9), path, "date")  # re-run one day
    got = {(r.day, r.t) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1.0), (2, 9.0), (3, 1.0)}
    partitioned.write_partitioned(_days(spark, [2], 9), path, "date")  # idempotent
    assert spark.read.parquet(path).count() == 3


def test_upsert_idempotent(spark):
    cur = spark.createDataFrame([(1, 1.0, dt.date(2024, 1, 1)), (2, 2.0, dt.date(2024, 1, 1))],
                                "k int, v double, extraction_date date")
    inc = spark.createDataFrame([(2, 5.0, dt.date(2024, 1, 2)), (3, 3.0, dt.date(2024, 1, 2))],
                                "k int, v double, extraction_date date")
    once = upsert.upsert(cur, inc, ["k"])
    twice = upsert.upsert(once, inc, ["k"])
    rows = sorted((r.k, r.v) for r in twice.collect())
    assert rows == sorted((r.k, r.v) for r in once.collect()) == [(1, 1.0), (2, 5.0), (3, 3.0)]


def test_same_extraction_incoming_wins(spark):
    cur = spark.createDataFrame([(1, 1.0, dt.date(2024, 1, 1))], "k int, v double, extraction_date date")
    inc = spark.createDataFrame([(1, 7.0, dt.date(2024, 1, 1))], "k int, v double, extraction_date date")
    assert upsert.upsert(cur, inc, ["k"]).first().v == 7.0


def test_upsert_incoming_wins(spark):
    schema = "k string, v double, extraction_date date"
    cur = spark.createDataFrame([("a", 1.0, dt.date(2024, 5, 1)), ("b", 1.0, dt.date(2024, 5, 1)), ("c", 1.0, None)], schema)
    inc = spark.createDataFrame([("a", 2.0, dt.date(2023, 1, 1)), ("b", 2.0, None)], schema)
    got = {r.k: (r.v, r.extraction_date) for r in upsert.upsert(cur, inc, ["k"], as_of=dt.date(2024, 6, 1)).collect()}
    assert got == {"a": (2.0, dt.date(2023, 1, 1)), "b": (2.0, dt.date(2024, 6, 1)), "c": (1.0, None)}
    assert {r.k: r.v for r in upsert.upsert(cur, inc, ["k"], newest_wins=True).collect()} == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_partial_upsert_new_column_and_repeats(spark):
    cur = spark.createDataFrame([("a", 1)], "k string, v int")
    inc = spark.createDataFrame([("a", 2, 7), ("b", 3, 8), ("b", 4, 9)], "k string, v int, extra int").coalesce(1)
    got = sorted(tuple(r) for r in upsert.partial_upsert(cur, inc, ["k"], ["v"]).select("k", "v", "extra").collect())
    assert got == [("a", 2, 7), ("b", 4, 9)]


def test_partial_upsert(spark):
    cur = spark.createDataFrame([("Tomate", 1.0, 60, 90)], "nom string, t double, cmin int, cmax int")
    inc = spark.createDataFrame([("Tomate", 9.0, 70, 95), ("Vigne", 2.0, 150, 210)],
                                "nom string, t double, cmin int, cmax int")
    out = {r.nom: tuple(r) for r in upsert.partial_upsert(cur, inc, ["nom"], ["cmin", "cmax"]).collect()}
    assert out == {"Tomate": ("Tomate", 1.0, 70, 95), "Vigne": ("Vigne", 2.0, 150, 210)}


def test_versioned_rejects_invalid(spark):
    import pytest

    from furrow.operators.quality import DataQualityError
    cur = spark.createDataFrame([], "loc int, target date, extraction_date date, m double")
    bad = spark.createDataFrame([(1, None, dt.date(2024, 1, 1), 1.0)], "loc int, target date, extraction_date date, m double")
    with pytest.raises(DataQualityError):
        upsert.versioned_upsert(cur, bad, ["loc", "target"], "extraction_date", ["m"], "target")
    good = spark.createDataFrame([(1, dt.date(2024, 1, 5), dt.date(2024, 1, 1), 1.0),
                                  (1, dt.date(2024, 1, 5), dt.date(2024, 1, 2), 2.0)],
                                 "loc int, target date, extraction_date date, m double")
    assert upsert.versioned_upsert(cur, good, ["loc", "target"], "extraction_date", ["m"], "target").count() == 2


def test_align_and_evolving_union(spark):
    a = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "date timestamp_ntz, temperature_2m_mean double")
    b = spark.createDataFrame([(dt.datetime(2024, 1, 2), "3.5")], "date timestamp_ntz, precipitation_sum string")
    out = align.prepare_wide_append(align.union_evolving([a, b]), "Sousse", 35.8, 10.6)
    assert out.columns == align.WIDE_DAILY_COLUMNS
    rows = sorted(out.collect(), key=lambda r: r.date_mesure)
    assert rows[0].temperature_2m_mean == 1.0 and rows[1].precipitation_sum == 3.5
    assert rows[1].temperature_2m_min is None and rows[0].city_name == "Sousse"


def test_dense_index_and_get_or_create(spark):
    df = spark.range(0, 1000).select(F.concat(F.lit("k"), F.format_string("%04d", "id")).alias("name"))
    ids = keys.dense_index(df, ["name"], start=11).orderBy("id").collect()
    assert [r.id for r in ids] == list(range(11, 1011))
    assert [r.name for r in ids] == sorted(r.name for r in ids)
    existing = spark.createDataFrame([(1, "a"), (5, "b")], "id int, name string")
    cand = spark.createDataFrame([("b",), ("c",), ("",), ("a",)], "name string").select(
        keys.source_name("name").alias("name"))
    got = sorted(tuple(r) for r in keys.get_or_create(existing, cand, ["name"]).collect())
    assert got == [(1, "a"), (5, "b"), (6, "c"), (7, "unknown")]


def test_upsert_partitions_rewrites_touched_only(spark, tmp_dir):
    import glob
    import os

    from furrow.streaming.incremental import upsert_partitions
    path = tmp_dir + "/facts"
    base = spark.createDataFrame([(1, dt.date(2023, 5, 1), 1.0, dt.date(2024, 1, 1), 2023),
                                  (1, dt.date(2024, 5, 1), 2.0, dt.date(2024, 1, 1), 2024)],
                                 "loc int, date date, t double, extraction_date date, year int")
    upsert_partitions(base, path, ["loc", "date"], ["extraction_date"], ["year"])
    before = {f: os.path.getmtime(f) for f in glob.glob(path + "/year=2023/*.parquet")}
    late = spark.createDataFrame([(1, dt.date(2024, 5, 1), 9.0, dt.date(2024, 1, 2), 2024),
                                  (2, dt.date(2024, 5, 2), 3.0, dt.date(2024, 1, 2), 2024)],
                                 "loc int, date date, t double, extraction_date date, year int")
    for _ in range(2):  # replay: same table
        upsert_partitions(late, path, ["loc", "date"], ["extraction_date"], ["year"])
        got = sorted((r.loc, str(r.date), r.t) for r in spark.read.parquet(path).collect())
        assert got == [(1, "2023-05-01", 1.0), (1, "2024-05-01", 9.0), (2, "2024-05-02", 3.0)]
    after = {f: os.path.getmtime(f) for f in glob.glob(path + "/year=2023/*.parquet")}
    assert before == after  # untouched partition kept its files


def test_yyyymm_partitions_and_zone_strip(spark, tmp_dir):
    hourly = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23), 1.0), (dt.datetime(2024, 2, 1, 1), 2.0)],
                                   "date timestamp, surface_pressure double")
    partitioned.write_partitioned(hourly, tmp_dir + "/h", "date", ("yyyymm",))
    assert sorted(r.yyyymm for r in spark.read.parquet(tmp_dir + "/h").collect()) == [202401, 202402]
    out = align.prepare_wide_append(hourly, "Sousse", 35.8, 10.6,
                                    columns=["date_mesure", "city_name", "surface_pressure"])
    assert out.schema["date_mesure"].dataType.simpleString() == "timestamp_ntz"
    assert str(out.orderBy("date_mesure").first().date_mesure) == "2024-01-31 23:00:00"


def test_source_priority_coalesce_mode(spark):
    from furrow.operators.merge import source_priority_merge
    a = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, dt.date(2024, 1, 1)),
                               (dt.date(2024, 1, 2), None, dt.date(2024, 1, 1))], "date date, t double, extraction_date date")
    b = spark.createDataFrame([(dt.date(2024, 1, 2), 5.0, 9.0, dt.date(2024, 1, 3))],
                              "date date, t double, rh double, extraction_date date")
    drop = {r.date.day: (r.t, r.rh) for r in source_priority_merge([("a", a), ("b", b)]).collect()}
    fillc = {r.date.day: (r.t, r.rh, str(r.extraction_date)) for r in
             source_priority_merge([("a", a), ("b", b)], mode="coalesce").collect()}
    assert drop == {1: (1.0, None), 2: (None, 9.0)}
    assert fillc == {1: (1.0, None, "2024-01-01"), 2: (5.0, 9.0, "2024-01-03")}


def test_hot_day_is_split_over_tasks(spark, tmp_dir):
    import glob
    hot = [(dt.date(2024, 1, 1), i, float(i)) for i in range(4000)]
    cold = [(dt.date(2024, 1, d), i, 1.0) for d in range(2, 6) for i in range(10)]
    df = spark.createDataFrame(hot + cold, "date date, id int, v double")
    partitioned.write_partitioned(df, tmp_dir + "/p", "date", sort_cols=["id"], num_tasks=8)
    hot_files = glob.glob(tmp_dir + "/p/year=2024/month=1/day=1/*.parquet")
    assert len(hot_files) > 1  # the hot day was written by several tasks
    assert spark.read.parquet(tmp_dir + "/p").count() == 4040
