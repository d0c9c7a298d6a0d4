"""How many tasks a range-partitioned step gets: a measure of its bytes.

``range_tasks`` takes one aggregate over the frame (rows, bytes of the variable
columns, distinct folders; one row per task is shuffled) and answers
``bytes / target``.  The target is Spark's own advisory partition size, so the
tasks of a day's load and of thirty years follow the same setting.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: a task is not made smaller than this to keep every core busy
MIN_TASK_BYTES = 1 << 20
#: folders one write task opens at most, on average
FOLDERS_PER_TASK = 256

# Bytes of a stored value by type; others are measured.
_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
          T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16, T.NullType: 0}


def row_bytes(df: DataFrame) -> tuple[int, Column]:
    """Bytes per row of fixed-width columns, and the bytes of the others; a null
    of variable width counts as nothing."""
    fixed, measured = 0, []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if type(f.dataType) in _WIDTH:
            fixed += _WIDTH[type(f.dataType)]
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            measured.append(F.octet_length(col))
        else:
            measured.append(F.octet_length(F.to_json(F.struct(col))))
    return fixed, sum((F.coalesce(m, F.lit(0)).cast("long") for m in measured), F.lit(0).cast("long"))


def target_bytes(df: DataFrame) -> int:
    """The session's advisory partition size in bytes (``64m``, ``128MB``, ``67108864b``)."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", df.sparkSession.conf.get(ADVISORY).strip().lower()).groups()
    return max(1, int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit])


def range_tasks(df: DataFrame, folders: Sequence[Column] = (), target: int | None = None) -> int:
    """Tasks for ``df``: its bytes over ``target``; more while every core can have
    ``MIN_TASK_BYTES``, or while a task would open over ``FOLDERS_PER_TASK`` folders.
    An empty frame gets one."""
    target = target or target_bytes(df)
    fixed, measured = row_bytes(df)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(measured).alias("b"),
                 (F.approx_count_distinct(F.struct(*folders)) if folders else F.lit(0)).alias("f")).first()
    size = got["n"] * fixed + (got["b"] or 0)
    spread = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / MIN_TASK_BYTES))
    return max(1, math.ceil(size / target), spread, math.ceil(got["f"] / FOLDERS_PER_TASK))
