"""Shards by jump consistent hashing (operator 11).

A row's 64-bit key walks the jumps of its own pseudo-random sequence and stops
in front of the first one beyond the number of shards: no ring table, no state,
and with one more shard a row either stays or moves into the new one.  The key
is an integer column itself (two's complement) or, for other types and several
columns, their xxhash64; with a key such as a digest of the text all copies of a
text share a shard.

``write_shards`` deals whole rows into folders ``shard=k``.  A shard may hold any
share of the rows: rows are range-partitioned by (shard, order, row number), so
that it is cut over tasks, and each file row carries its place in its piece; the
manifest, one row per task, holds what stands before.  ``read_shards`` puts both
together: (shard, slot) with slots gapless from 0 in the order given.

Defined cases: null keys share key 0 (one column) or the hash of nulls; rows
that repeat get a slot each, in no stated order among themselves; null and empty
texts are kept; an empty table gives no rows; further columns are kept, those
called piece, at, ordinal, shard or slot are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import plain, scan, settle
from furrow.session import scratch_path

#: the multiplier of the published algorithm's linear congruential sequence
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    keys = keys.astype(np.uint64, copy=True)
    shard, ahead, live = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(live):
        shard[live] = ahead[live]
        k = keys[live] * STEP + np.uint64(1)
        keys[live] = k
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def key_of(df: DataFrame, *cols: str) -> Column:
    """The 64-bit key of one or more columns."""
    if len(cols) == 1 and isinstance(df.schema[cols[0]].dataType, T.IntegralType):
        return F.coalesce(F.col(f"`{cols[0]}`").cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(*plain(*cols))


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key made by ``key_of``, by whole Arrow batches."""
    @F.pandas_udf("int")
    def deal(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return deal(key)


def write_shards(docs: DataFrame, shards: int = 16, key: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("doc_id",), folder: str | None = None) -> str:
    """Deal ``docs`` into ``folder`` (a fresh one in the shared checkpoint
    folder if None) and return it."""
    folder = folder or scratch_path(docs.sparkSession, "shards")
    kept = docs.select(*plain(*[c for c in docs.columns if c.lower() not in ("piece", "at", "ordinal", "shard", "slot")]))
    rows, _ = scan(kept.withColumn("shard", shard_of(key_of(kept, *key), shards)), "shard", list(order), folder, by=("shard",))
    docs.sparkSession.createDataFrame([], rows.schema).write.parquet(f"{folder}/layout")  # the columns, also of no rows
    return folder


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The dealt rows with shard and slot."""
    rows = spark.read.schema(spark.read.parquet(f"{folder}/layout").schema).parquet(f"{folder}/rows")
    return settle(rows, spark.read.parquet(f"{folder}/pieces"), "shard").withColumnRenamed("at", "slot").drop("ordinal")
