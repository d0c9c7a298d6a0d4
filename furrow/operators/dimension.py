"""Dimension tables with lasting surrogate ids (ops 12.1, 12.2).

A dictionary folder holds ``data/<run>/`` with the rows one run added and
``log/<version>.json``: the highest id given and the runs that count.  A run
finds the keys that no committed run has, numbers them behind the highest id,
writes them, and claims that range of ids by putting the next record in place, in
one step that fails if another run was faster; then it looks again, against the
other run's rows.  So ids have no gaps, a key never gets two, and a given id never
changes.  A run that dies before its claim leaves no trace in the table.

Attributes are those of a key's first row (smallest by the attributes in order);
a key that is known keeps the attributes it has.  Rows with a null in the key get
no id.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.dedup import first_by_key
from furrow.operators.keys import dense_index
from furrow.streaming.versions import _Folder, versions

#: coordinates are compared with six decimals (fixed by the location table)
COORDINATE = "decimal(9,6)"


def coordinate(c) -> Column:
    """A latitude or longitude as the location table keys it; null if it does not fit."""
    return (c if isinstance(c, Column) else F.col(c)).try_cast(COORDINATE)


def _record(spark: SparkSession, path: str) -> dict:
    known = versions(spark, path)
    return json.loads(_Folder(spark, path).read(f"log/{known[-1]:012d}.json")) if known else {"version": 0, "top": 0, "runs": [], "schema": None}


def _rows(spark: SparkSession, path: str, rec: dict, schema: T.StructType) -> DataFrame:
    folders = [f"{path.rstrip('/')}/data/{r}" for r in rec["runs"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    rec = _record(spark, path)
    if rec["schema"] is None:
        raise FileNotFoundError(f"no dimension at {path}")
    return _rows(spark, path, rec, T.StructType.fromJson(rec["schema"]))


def get_or_create_rows(candidates: DataFrame, path: str, key_cols: Sequence[str], attr_cols: Sequence[str] = (),
                       id_col: str = "id", tries: int = 5) -> DataFrame:
    """The dimension at ``path`` with every key of ``candidates`` in it."""
    spark, cols = candidates.sparkSession, [*key_cols, *attr_cols]
    offered = first_by_key(candidates.select(*cols).dropna(subset=list(key_cols)), list(key_cols), list(attr_cols) or list(key_cols))
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[offered.schema[c] for c in cols]])
    for _ in range(tries):
        rec = _record(spark, path)
        known = _rows(spark, path, rec, schema)
        new = offered.join(known.select(*key_cols), list(key_cols), "left_anti")
        numbered = dense_index(new.select(*cols), key_cols, id_col=id_col, start=rec["top"] + 1)
        top = numbered.agg(F.max(id_col).alias("m")).first()["m"]
        if top is None:
            if rec["schema"] is None:
                _claim(spark, path, {**rec, "version": 1, "schema": schema.jsonValue()})
            return known
        run = f"{rec['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        numbered.select(schema.names).write.parquet(f"{path.rstrip('/')}/data/{run}")
        if _claim(spark, path, {"version": rec["version"] + 1, "top": int(top), "runs": [*rec["runs"], run], "schema": schema.jsonValue()}):
            return read_dimension(spark, path)
    raise RuntimeError(f"{tries} other runs were faster at {path}")


def _claim(spark: SparkSession, path: str, rec: dict) -> bool:
    return _Folder(spark, path).put(f"log/{rec['version']:012d}.json", json.dumps(rec, sort_keys=True))


def get_or_create_locations(candidates: DataFrame, path: str, lat: str = "latitude", lon: str = "longitude", city: str = "city_name") -> DataFrame:
    """The location table: id, latitude and longitude with six decimals, city_name."""
    offered = candidates.select(coordinate(lat).alias("latitude"), coordinate(lon).alias("longitude"), F.col(city).alias("city_name"))
    return get_or_create_rows(offered, path, ["latitude", "longitude"], ["city_name"])
