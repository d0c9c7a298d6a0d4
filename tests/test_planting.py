"""Planting window against a direct (sliding-frame) Python computation, several plants and cycles."""

import datetime as dt
import math
import random

from furrow.plans import planting
from furrow.sources.reference import PLANT_ROWS, plants


def _daily_rows(seed=3, years=(2014, 2026)):
    rnd = random.Random(seed)
    rows = []
    for loc in ("sousse", "tunis"):
        d = dt.date(years[0], 1, 1)
        while d <= dt.date(years[1], 1, 31):
            if rnd.random() > 0.03:  # gaps: rows, not days
                base = 18 + 10 * math.sin((d.timetuple().tm_yday / 365.0) * 2 * math.pi) + rnd.uniform(-4, 4)
                rain = None if rnd.random() < 0.05 else round(max(0.0, rnd.gauss(1, 3)), 2)
                rows.append((loc, d, base, base - rnd.uniform(3, 8), base + rnd.uniform(3, 9), rain))
            d += dt.timedelta(days=1)
    return rows


def _brute(rows, plant, ref=dt.date(2026, 1, 31), cap=1500.0):
    name, cmin, cmax, amin, amax, cycle = plant[0], plant[1], plant[2], plant[3], plant[4], plant[8]
    out = {}
    for loc in sorted({r[0] for r in rows}):
        series = sorted([r for r in rows if r[0] == loc], key=lambda r: r[1])
        p = [1 if cmin <= r[2] <= cmax else 0 for r in series]
        x = [1 if (r[3] < amin or r[4] > amax) else 0 for r in series]
        rain = [r[5] or 0.0 for r in series]
        groups = {}
        for i, r in enumerate(series):
            if r[1] > ref - dt.timedelta(days=cycle):
                continue
            germ = sum(p[i:i + 7])
            perf = sum(p[i:i + cycle + 1])
            fat = sum(x[i:i + cycle + 1])
            tot = sum(rain[i:i + cycle + 1])
            ok = int(germ >= 5 and perf >= cycle * 0.4 and fat == 0 and tot <= cap)
            age = ref.year - r[1].year
            w = 1.0 if age <= 5 else 1.0 / math.sqrt(age)
            groups.setdefault((r[1].month, r[1].day), []).append((ok, w, tot))
        res = []
        for (m, d), g in groups.items():
            if len(g) < 5:
                continue
            sw = sum(w for _, w, _ in g)
            ssw = sum(o * w for o, w, _ in g)
            res.append((m, d, len(g), round(sw, 2), round(ssw, 2), round(ssw / sw * 100, 1),
                        round(sum(t * w for _, w, t in g) / sw, 1)))
        res.sort(key=lambda t: (-t[5], -t[4], t[0], t[1]))
        out[(loc, name)] = res[:30]
    return out


def test_planting_matches_brute_force(spark):
    rows = _daily_rows()
    daily = spark.createDataFrame(rows, "location string, day_date date, daytime_temp_avg double, "
                                        "daily_temp_min double, daily_temp_max double, daily_rain double")
    chosen = [PLANT_ROWS[0], PLANT_ROWS[3], PLANT_ROWS[8]]  # cycles 60, 70, 70
    dim = plants(spark, chosen)
    req = spark.createDataFrame([(loc, p[0]) for loc in ("sousse", "tunis") for p in chosen],
                                "location string, nom_du_plante string")
    got = planting.planting_windows(daily, dim, req, ["location"]).collect()
    by_key = {}
    for r in got:
        by_key.setdefault((r.location, r.nom_du_plante), []).append(
            (r.month, r.day, r.years_analyzed, r.weighted_years_analyzed, r.weighted_successful_years,
             r.success_probability_pct, r.expected_rainfall_mm))
    for p in chosen:
        want = _brute(rows, p)
        for key, res in want.items():
            mine = sorted(by_key.get(key, []), key=lambda t: (-t[5], -t[4], t[0], t[1]))
            assert len(mine) == len(res)
            for a, b in zip(mine, res):
                assert a[:3] == b[:3]
                assert all(abs(u - v) < 0.051 for u, v in zip(a[3:], b[3:])), (key, a, b)


def test_single_tool_query(spark):
    hourly = spark.createDataFrame(
        [("Sousse", dt.datetime(2020, 5, 1, h), 20.0 + h / 10, 0.1) for h in range(24)],
        "city_name string, date_mesure timestamp_ntz, temperature_2m_mean double, precipitation_sum double")
    out = planting.optimal_planting_window(hourly, plants(spark), "sousse", "tomate")
    assert out.count() == 0  # one day of history: no (month, day) has 5 years
    daily = planting.daily_rollup(hourly, "date_mesure", "temperature_2m_mean", "precipitation_sum", ["city_name"])
    r = daily.first()
    assert abs(r.daytime_temp_avg - (20.0 + 1.2)) < 1e-9 and abs(r.daily_rain - 2.4) < 1e-9


def test_batch_form_matches_windows(spark):
    hourly = spark.createDataFrame(
        [(loc, dt.datetime(y, 5, d, h), 20.0 + (d % 5) + h / 100, 0.2)
         for loc in ("a", "b") for y in range(2015, 2022) for d in range(1, 29) for h in (0, 12)],
        "city_name string, date_mesure timestamp_ntz, temperature_2m_mean double, precipitation_sum double")
    req = spark.createDataFrame([("a", "Tomate"), ("b", "pastèque")], "city_name string, nom_du_plante string")
    got = planting.all_planting_windows(hourly, plants(spark), req, ref_date="2021-12-31")
    daily = planting.daily_rollup(hourly, "date_mesure", "temperature_2m_mean", "precipitation_sum", ["city_name"])
    want = planting.planting_windows(daily, plants(spark), req, ["city_name"], ref_date="2021-12-31")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0


def test_history_bound_reaches_the_scan(spark, tmp_dir):
    rows = [("Sousse", dt.datetime(1990 + y, 3, 1, 12), 20.0, 0.1) for y in range(36)]
    spark.createDataFrame(rows, "city_name string, date_mesure timestamp_ntz, temperature_2m_mean double, "
                                "precipitation_sum double").write.parquet(tmp_dir + "/hourly")
    hourly = spark.read.parquet(tmp_dir + "/hourly")
    out = planting.optimal_planting_window(hourly, plants(spark), "sousse", "tomate")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_mesure,1996-01-31T00:00)" in plan  # 30 years before 2026-01-31
    assert "ReadSchema: struct<city_name:string,date_mesure:timestamp_ntz,temperature_2m_mean:double," in plan
