"""Normaliser pipelines on inline frames."""

import datetime as dt

from furrow.operators.normalize import nasapower_daily, openmeteo_daily, openmeteo_forecast


def test_forecast_rules(spark):
    rows = [("s", dt.date(2024, 1, d), code, tmax, tmin, p, w)
            for d, code, tmax, tmin, p, w in [
                (1, 4.0, 20.0, 10.0, -1.0, 151.0), (2, 59.0, 99.0, 11.0, 500.1, 150.0),
                (3, 2.5, 24.0, None, 3.0, -2.0), (4, None, 26.0, 13.0, 0.0, 10.0)]]
    df = spark.createDataFrame(rows, "location string, date date, weather_code double, temperature_2m_max double, "
                                     "temperature_2m_min double, precipitation_sum double, wind_speed_10m_max double")
    out = {r.date.day: r for r in openmeteo_forecast(df, "2024-01-01").collect()}
    assert [out[d].weather_code for d in (1, 2, 3, 4)] == [3.0, 57.0, 2.0, None]
    assert out[2].temperature_2m_max == 22.0  # 99 out of bounds, interpolated between 20 and 24
    assert out[3].temperature_2m_min == 12.0
    assert [out[d].precipitation_sum for d in (1, 2, 3)] == [0.0, 0.0, 3.0]
    assert [out[d].wind_speed_10m_max for d in (1, 2, 3)] == [150.0, 150.0, 0.0]
    assert out[1].source == "openmeteo" and str(out[1].extraction_date) == "2024-01-01"


def test_openmeteo_daily_swap_and_repair(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1), 30.0, 10.0, 20.0, "5"),
                                ("s", dt.date(2024, 1, 2), 5.0, 10.0, 20.0, "bad")],
                               "location string, date date, temperature_2m_mean double, temperature_2m_max double, "
                               "temperature_2m_min double, precipitation_sum string")
    out = {r.date.day: r for r in openmeteo_daily(df, "2024-01-01").collect()}
    assert (out[1].temperature_2m_min, out[1].temperature_2m_max, out[1].temperature_2m_mean) == (10.0, 20.0, 15.0)
    assert out[1].precipitation_sum == 5.0 and out[2].precipitation_sum is None


def test_nasapower_daily(spark):
    long = spark.createDataFrame([
        ("s", dt.date(2024, 1, 1), "T2M", 10.0), ("s", dt.date(2024, 1, 2), "T2M", -999.0),
        ("s", dt.date(2024, 1, 3), "T2M", 14.0), ("s", dt.date(2024, 1, 1), "RH2M", 130.0),
        ("s", dt.date(2024, 1, 1), "ALLSKY_SFC_SW_DWN", 9.0), ("s", dt.date(2024, 1, 1), "CLRSKY_SFC_SW_DWN", 7.0),
        ("s", dt.date(2024, 1, 2), "ALLSKY_SFC_SW_DWN", 5.0), ("s", dt.date(2024, 1, 1), "WS2M", -1.0)],
        "location string, date date, parameter string, value double")
    out = {r.date.day: r for r in nasapower_daily(long, "2024-01-01").collect()}
    assert out[2].temperature_2m_mean == 12.0
    assert out[1].relative_humidity_2m == 100.0
    assert out[1].all_sky_surface_shortwave_radiation_downward == 7.0
    assert out[2].all_sky_surface_shortwave_radiation_downward == 5.0  # null clear-sky: unchanged
    assert out[1].wind_speed_2m == 0.0 and out[1].source == "nasapower"
