"""Pure-rule unit tests on tiny inline frames with the edge rows of FIXTURES section 2."""

import math

from pyspark.sql import functions as F

from furrow.functions import cleaning as C

NAN = float("nan")


def col_values(spark, values, expr, dtype="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_sentinel_and_nan(spark):
    out = col_values(spark, [-999.0, 1.0, None, NAN], lambda c: C.coerce_numeric(C.sentinel_to_null(c)))
    assert out == [None, 1.0, None, None]


def test_coerce_text(spark):
    out = col_values(spark, [" 12 ", "n/a", "NaN", None, "1e2", ""], C.coerce_numeric, "string")
    assert out == [12.0, None, None, None, 100.0, None]


def test_bounds_inclusive(spark):
    out = col_values(spark, [-50.0, 60.0, -50.1, 60.1, None], lambda c: C.null_outside(c, -50, 60))
    assert out == [-50.0, 60.0, None, None, None]


def test_precipitation_rule(spark):
    out = col_values(spark, [-1.0, 0.0, 500.0, 500.1, None], C.precipitation_rule)
    assert out == [0.0, 0.0, 500.0, 0.0, None]


def test_clip_keeps_null(spark):
    out = col_values(spark, [-3.0, 130.0, 50.0, None], lambda c: C.clip(c, 0, 100))
    assert out == [0.0, 100.0, 50.0, None]
    wind = col_values(spark, [150.0, 151.0, -2.0], lambda c: C.clip(c, 0, 150))
    assert wind == [150.0, 150.0, 0.0]


def test_floor_zero(spark):
    assert col_values(spark, [-0.5, 0.0, 2.0, None], C.floor_zero) == [0.0, 0.0, 2.0, None]


def test_cap_by_column(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0), (2, None, 3.0), (3, 2.0, None), (4, 2.0, 3.0)],
                               "i int, a double, c double")
    out = [r[0] for r in df.orderBy("i").select(C.cap_by("a", "c")).collect()]
    assert out == [3.0, None, 2.0, 2.0]


def test_swap_then_mean_repair(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, 20.0), (2, 1.0, 4.0, 2.0), (3, None, 4.0, 2.0)],
                               "i int, mn double, mx double, mean double")
    mn, mx = C.swap_min_max("mn", "mx")
    swapped = df.select("i", mn.alias("mn"), mx.alias("mx"), "mean")
    out = swapped.orderBy("i").select("mn", "mx", C.repair_mean("mean", "mn", "mx").alias("m")).collect()
    assert [tuple(r) for r in out] == [(5.0, 10.0, 7.5), (1.0, 4.0, 2.0), (None, 4.0, 2.0)]


def test_nearest_code(spark):
    out = col_values(spark, [4.0, 46.0, 59.0, 70.0, 97.0, 2.5, None, 3.5, 100.0], C.nearest_code)
    assert out == [3.0, 45.0, 57.0, 71.0, 96.0, 2.0, None, 3.0, 99.0]


def test_nearest_code_matches_python(spark):
    vals = [x / 4 for x in range(-20, 420)]
    got = col_values(spark, vals, C.nearest_code)
    for v, g in zip(vals, got):
        r = round(v)  # Python rounds half to even
        want = min(C.WEATHER_CODES, key=lambda c: (abs(c - r), c))
        assert g == float(want), (v, g, want)
    assert not any(isinstance(g, float) and math.isnan(g) for g in got)
