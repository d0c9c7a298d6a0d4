"""Date helpers (ops 9.1-9.9) on inline rows."""

import datetime as dt

from pyspark.sql import functions as F

from furrow.functions import dates as D


def test_date_helpers(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 28), "20240229", "2024-03-01T02:30:00+02:00", 86400)],
                               "d date, compact string, iso string, epoch long")
    r = df.select(
        F.size(D.forecast_days("d")).alias("n"), F.element_at(D.forecast_days("d"), -1).alias("last"),
        D.parse_compact_date("compact").alias("parsed"), D.parse_iso_timestamp("iso").alias("utc"),
        D.epoch_to_timestamp("epoch").alias("ts"), D.history_target("d").alias("hist"),
        D.shift_years("d", -30).alias("back"), D.yyyymm("d").alias("ym"),
        D.source_for_window(F.date_add("d", 7), F.lit(dt.date(2024, 3, 1))).alias("src")).first()
    assert r.n == 8 and str(r.last) == "2024-03-06"
    assert str(r.parsed) == "2024-02-29" and str(r.utc) == "2024-03-01 00:30:00"
    assert str(r.ts) == "1970-01-02 00:00:00" and str(r.hist) == "2024-02-26"
    assert str(r.back) == "1994-02-28" and r.ym == 202402 and r.src == "forecast"
