"""The planting and soil tools as SQL table functions (op 11.2).

``register_tools`` names two lazy frames and puts temporary SQL functions on top,
so that any SQL of the session can ask

    SELECT * FROM planting_window('Sousse', 'tomate')
    SELECT * FROM soil_check('tomate', 'argileux')

and join the answer.  The functions hold no logic of their own: the first is a
filter on ``planting.all_planting_windows`` of every city and crop.  The filter is
on the keys that all its windows and aggregates are partitioned by, so Catalyst
pushes it below them, to the scan of the hourly facts and to the crop table; a
call computes the pairs it asks for and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.search import SOIL_DOES_NOT_FIT, SOIL_FITS, SOIL_NONE, SOIL_UNKNOWN_PLANT
from furrow.plans import planting

PLANTING_COLUMNS = ("city_name string, nom_du_plante string, month int, day int, years_analyzed bigint, weighted_years_analyzed double, "
                    "weighted_successful_years double, success_probability_pct double, expected_rainfall_mm double")


def planting_answers(hourly: DataFrame, plants: DataFrame, ref_date: str = planting.DEFAULT_REF_DATE,
                     years_back: int = planting.DEFAULT_YEARS_BACK, city_col: str = "city_name", **kw) -> DataFrame:
    """Windows of every crop in every city, history bounded by ``years_back``."""
    # a city asks for every crop of the dimension: names as one bounded array
    names = sorted({r[0] for r in plants.select("nom_du_plante").distinct().collect() if r[0] is not None})
    cities = hourly.where(F.col(city_col).isNotNull()).select(F.col(city_col).alias("city_name")).distinct()
    requests = cities.select("city_name", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("nom_du_plante"))
    return planting.all_planting_windows(hourly.withColumnRenamed(city_col, "city_name"), plants, requests,
                                         loc_cols=("city_name",), ref_date=ref_date, years_back=years_back, **kw)


def register_tools(hourly: DataFrame, plants: DataFrame, ref_date: str = planting.DEFAULT_REF_DATE, **kw) -> None:
    """Temporary functions ``planting_window(city, plant)`` and
    ``soil_check(plant, soil)``; both arguments match in any case, and ``%`` and
    ``_`` of the first function's are wildcards, as in the tool (ILIKE)."""
    spark = hourly.sparkSession
    planting_answers(hourly, plants, ref_date, **kw).createOrReplaceTempView("planting_answers")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION planting_window(city STRING, plant STRING)
        RETURNS TABLE ({PLANTING_COLUMNS})
        RETURN SELECT {", ".join(c.split()[0] for c in PLANTING_COLUMNS.split(", "))} FROM planting_answers
               WHERE city_name ILIKE planting_window.city AND nom_du_plante ILIKE planting_window.plant""")
    if "nature_des_sols" not in plants.columns:
        return
    soils = F.coalesce(F.col("nature_des_sols"), F.array().cast("array<string>"))
    plants.select("nom_du_plante", soils.alias("soils")).createOrReplaceTempView("plant_soils")
    quoted = {k: v.replace("'", "\\'") for k, v in {"unknown": SOIL_UNKNOWN_PLANT, "fits": SOIL_FITS, "not": SOIL_DOES_NOT_FIT, "none": SOIL_NONE}.items()}
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION soil_check(plant STRING, soil STRING)
        RETURNS TABLE (plant STRING, soil STRING, compatible BOOLEAN, allowed_soils STRING, message STRING)
        RETURN SELECT q.plant, q.soil, q.ok, array_join(q.soils, ', '),
                      CASE WHEN q.name IS NULL THEN format_string('{quoted["unknown"]}', q.plant)
                           WHEN q.ok THEN format_string('{quoted["fits"]}', q.soil, q.plant)
                           ELSE format_string('{quoted["not"]}', q.soil, q.plant, if(size(q.soils) = 0, '{quoted["none"]}', array_join(q.soils, ', '))) END
               FROM (SELECT a.plant, a.soil, p.nom_du_plante AS name, p.soils,
                            coalesce(array_contains(transform(p.soils, x -> lower(trim(x))), lower(trim(a.soil))), false) AS ok
                     FROM (SELECT soil_check.plant AS plant, soil_check.soil AS soil) a
                     LEFT JOIN plant_soils p ON lower(p.nom_du_plante) = lower(a.plant)) q""")
