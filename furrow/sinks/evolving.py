"""Files whose columns and types change from load to load (op 2.9).

A table folder holds ``data/<load>/`` with the Parquet files of each load as they
came, and ``log/<version>.json``, a schema log: the table's columns so far, every
load's folder and the types it was written with.  A new metric adds a column, a
wider type widens the column; no file is written again.  The log record is put in
place by a rename that fails if the name exists, so a load that dies leaves the
table as it was, its replay appends once, and of two loads at one time the later
one meets the other's columns.

``read_evolving`` gives the table as one frame: all loads that agree on the
widened columns are one scan (absent columns are null), so there are as many scans
as ways in which columns were widened, not as many as loads.

Widening (fixed): integers to longer ones, any integer or float to double, a date
to a timestamp, an untyped (all-null) column to any.  A column that can't be
widened is an error that names it, before anything is written.  Names match in any
case; the first spelling stays.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.streaming.versions import _Folder, versions

_INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FLOATS = [T.FloatType(), T.DoubleType()]
_TIMES = (T.TimestampType(), T.TimestampNTZType())


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds both, or None."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _INTEGERS and b in _INTEGERS:
        return max(a, b, key=_INTEGERS.index)
    if a in _INTEGERS + _FLOATS and b in _INTEGERS + _FLOATS:
        return T.DoubleType()
    for day, time in ((a, b), (b, a)):
        if isinstance(day, T.DateType) and time in _TIMES:
            return time
    return None


def widen(table: T.StructType, load: T.StructType) -> T.StructType:
    """The table's schema after a load: its columns, then the new ones."""
    known = {f.name.lower(): f for f in table.fields}
    bad = []
    for f in load.fields:
        old = known.get(f.name.lower())
        kind = f.dataType if old is None else wider(old.dataType, f.dataType)
        if kind is None:
            bad.append(f"{f.name}: {old.dataType.simpleString()} and {f.dataType.simpleString()}")
        else:
            known[f.name.lower()] = T.StructField(old.name if old else f.name, kind)
    if bad:
        raise TypeError("no common type for " + ", ".join(bad))
    return T.StructType(list(known.values()))


def _record(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    version = version or (known[-1] if known else 0)
    if version not in known:
        return {"version": 0, "schema": T.StructType([]).jsonValue(), "loads": []}
    return json.loads(_Folder(spark, path).read(f"log/{version:012d}.json"))


def append_evolving(df: DataFrame, path: str, load: str) -> bool:
    """Append ``df`` as ``load``; False if a load of that name is in the table.

    Columns that are null throughout by type (void) hold nothing and aren't
    written; they join the table when a load gives them a type."""
    spark = df.sparkSession
    typed = df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.NullType)])
    folder = None
    while True:
        rec = _record(spark, path)
        if any(x["load"] == load for x in rec["loads"]):
            return False
        schema = widen(T.StructType.fromJson(rec["schema"]), typed.schema)
        if folder is None:
            folder = f"data/{uuid.uuid4().hex[:12]}"
            typed.write.parquet(f"{path}/{folder}")
        types = {f.name.lower(): f.dataType.jsonValue() for f in typed.schema.fields}
        rec = {"version": rec["version"] + 1, "schema": schema.jsonValue(),
               "loads": [*rec["loads"], {"load": load, "folder": folder, "types": types}]}
        if _Folder(spark, path).put(f"log/{rec['version']:012d}.json", json.dumps(rec, sort_keys=True)):
            return True


def read_evolving(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All loads of the table (as of ``version``) under its widened schema."""
    rec = _record(spark, path, version)
    if not rec["loads"]:
        raise FileNotFoundError(f"no load in a table at {path}")
    schema = T.StructType.fromJson(rec["schema"])
    groups: dict[str, list[str]] = {}
    for x in rec["loads"]:
        narrow = {f.name: x["types"][f.name.lower()] for f in schema.fields if x["types"].get(f.name.lower(), f.dataType.jsonValue()) != f.dataType.jsonValue()}
        groups.setdefault(json.dumps(narrow, sort_keys=True), []).append(f"{path}/{x['folder']}")
    frames = []
    for narrow, folders in groups.items():
        as_written = T.StructType.fromJson({"type": "struct", "fields": [
            {"name": f.name, "type": json.loads(narrow).get(f.name, f.dataType.jsonValue()), "nullable": True, "metadata": {}} for f in schema.fields]})
        scan = spark.read.schema(as_written).parquet(*folders)
        frames.append(scan.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]))
    return reduce(DataFrame.unionAll, frames)
