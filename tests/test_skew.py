"""Salted joins and bucketed tables."""

import datetime as dt

from pyspark.sql import functions as F

from furrow.operators.merge import spread_daily_on_hourly
from furrow.operators.skew import salted_join
from furrow.sinks import partitioned


def test_salted_join_equals_plain(spark):
    big = spark.range(0, 3000).select((F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 7)).alias("k"),
                                      F.col("id").alias("v"))
    small = spark.createDataFrame([(1, "hot"), (2, "b"), (3, "c"), (3, "c2")], "k long, tag string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
        got = sorted(map(tuple, salted_join(big, small, ["k"], how, buckets=8).collect()), key=str)
        assert got == want, how


def test_salted_daily_spread(spark):
    hourly = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, h), float(h), dt.date(2024, 1, 1)) for h in range(24)],
                                   "loc string, date timestamp_ntz, p double, extraction_date date")
    daily = spark.createDataFrame([("s", dt.date(2024, 1, 1), 5.0, dt.date(2024, 1, 2))],
                                  "loc string, date date, t double, extraction_date date")
    a = sorted(map(tuple, spread_daily_on_hourly(hourly, daily, ["loc"]).collect()))
    b = sorted(map(tuple, spread_daily_on_hourly(hourly, daily, ["loc"], salt_buckets=4).collect()))
    assert a == b and len(a) == 24 and all(r[3] == 5.0 for r in a)


def test_bucketed_join_skips_shuffle(spark, tmp_dir):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS furrow_b LOCATION '{tmp_dir}/db'")
    facts = spark.range(0, 1000).select((F.col("id") % 50).alias("loc"), F.col("id").alias("v"))
    dims = spark.range(0, 50).select(F.col("id").alias("loc"), (F.col("id") * 2).alias("w"))
    partitioned.write_bucketed(facts, "furrow_b.facts", ["loc"], 8)
    partitioned.write_bucketed(dims, "furrow_b.dims", ["loc"], 8)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("furrow_b.facts").join(spark.table("furrow_b.dims"), "loc")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and j.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql("DROP TABLE furrow_b.facts")
        spark.sql("DROP TABLE furrow_b.dims")
        spark.sql("DROP DATABASE furrow_b")
