"""Surrogate keys: get-or-create ids (ops 4.5, 12.1, 12.2).

Dense, consecutive ids without a single-partition window: new keys are
range-partitioned and sorted, each partition counts its rows, the
per-partition counts give each partition its offset, and a row's
id is ``base + offset(partition) + position in partition``.  The numbered
frame is written once below the shared checkpoint folder first, so the range
bounds (found by sampling) cannot change between the counting job and later
reads.  The per-partition counts
(one small number per partition) are the only values read back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.ranges import range_tasks
from furrow.session import cut_lineage


def dense_index(df: DataFrame, order: Sequence[str], id_col: str = "id", start: int = 1,
                num_partitions: int | None = None) -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` in ``order`` (ties broken by all columns)."""
    n = num_partitions or range_tasks(df)
    order = list(order) + [c for c in df.columns if c not in order]
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    # the ids are stored as columns, so the written copy keeps them exact
    ranged = cut_lineage(ranged, "dense-index")
    # monotonically_increasing_id = (partition index << 33) + row index in partition
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    # one count per partition: what is read back and broadcast is as many numbers as there are tasks
    counts = sorted((r["__pid"], r["n"]) for r in
                    ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(pid, off) for (pid, _), off in zip(counts, before)], "__pid int, __off long")
    return ranged.join(F.broadcast(offsets), "__pid").select(*df.columns, (F.lit(start) + F.col("__off") + local).cast("long").alias(id_col))


def get_or_create(existing: DataFrame, candidates: DataFrame, key_cols: Sequence[str],
                  id_col: str = "id") -> DataFrame:
    """Existing ``(id, keys)`` plus new keys numbered after the current max id.

    New keys are found with ``left_anti`` (op 4.5) and numbered in key order.
    """
    key_cols = list(key_cols)
    new = candidates.select(*key_cols).distinct().join(existing.select(*key_cols), key_cols, "left_anti")
    base = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"]
    numbered = dense_index(new, key_cols, id_col=id_col, start=int(base) + 1)
    return existing.select(id_col, *key_cols).unionByName(
        numbered.select(F.col(id_col).cast(existing.schema[id_col].dataType), *key_cols))


def source_name(c) -> F.Column:
    """Empty or null source names become ``unknown`` (op 12.2)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("unknown"))
