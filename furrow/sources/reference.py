"""Inline reference tables (op 1.11) and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PLANT_SCHEMA = T.StructType([
    T.StructField("nom_du_plante", T.StringType(), False),
    T.StructField("temp_min_opt", T.DoubleType()),
    T.StructField("temp_max_opt", T.DoubleType()),
    T.StructField("temp_min_abs", T.DoubleType()),
    T.StructField("temp_max_abs", T.DoubleType()),
    T.StructField("precipitation_min_opt", T.DoubleType()),
    T.StructField("precipitation_max_opt", T.DoubleType()),
    T.StructField("nature_des_sols", T.ArrayType(T.StringType())),
    T.StructField("crop_cycle_min", T.IntegerType()),
    T.StructField("crop_cycle_max", T.IntegerType()),
])

# The crop requirement rows the agronomic queries are defined on.
# Columns: name, temp_min_opt, temp_max_opt, temp_min_abs, temp_max_abs,
# precipitation_min_opt, precipitation_max_opt, soils, crop_cycle_min, crop_cycle_max.
PLANT_ROWS = [
    ("Tomate", 20.0, 27.0, 7.0, 35.0, 1.64, 3.56, ["Fluvisols", "Cambisols", "Luvisols", "Calcisols"], 60, 90),
    ("Olivier", 20.0, 34.0, 5.0, 40.0, 1.09, 1.92, ["Calcisols", "Cambisols", "Luvisols", "Regosols"], 150, 180),
    ("Blé", 15.0, 23.0, 5.0, 27.0, 2.05, 2.46, ["Luvisols", "Cambisols", "Calcisols", "Vertisols"], 120, 150),
    ("Pomme de terre", 15.0, 25.0, 7.0, 30.0, 1.37, 2.19, ["Cambisols", "Fluvisols", "Luvisols"], 70, 120),
    ("Oignon", 12.0, 25.0, 4.0, 30.0, 350.0, 550.0, ["Fluvisols", "Cambisols", "Luvisols"], 100, 150),
    ("Piment", 17.0, 30.0, 8.0, 35.0, 1.64, 3.42, ["Fluvisols", "Cambisols", "Luvisols", "Calcisols"], 90, 120),
    ("Orange", 20.0, 30.0, 13.0, 38.0, 3.28, 5.48, ["Fluvisols", "Luvisols", "Cambisols"], 240, 300),
    ("Vigne", 18.0, 28.0, 9.0, 32.0, 3.29, 3.83, ["Calcisols", "Luvisols", "Cambisols"], 150, 210),
    ("pastèque", 20.0, 35.0, 15.0, 40.0, 1.37, 1.92, ["Regosols", "Fluvisols", "Calcisols"], 70, 90),
]

LOCATION_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("city_name", T.StringType()),
    T.StructField("latitude", T.DecimalType(9, 6)),
    T.StructField("longitude", T.DecimalType(9, 6)),
])

DATA_SOURCE_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType()),
])


def plants(spark: SparkSession, rows=None) -> DataFrame:
    """The plant requirement dimension (9 rows unless ``rows`` is given)."""
    return spark.createDataFrame(rows if rows is not None else PLANT_ROWS, PLANT_SCHEMA)
