"""Incremental daily load as Structured Streaming (op 10.1).

New landed files are picked up by a file stream (``trigger(availableNow)``
processes everything present, then stops, like a scheduled daily run).  Each
micro-batch is cleaned by the caller's batch function and merged into the
target by key, latest extraction wins, so late or repeated files replace
earlier rows.

The target is a partitioned Parquet table whose partition columns are a
function of the key (e.g. ``year(date)`` for a ``(location, date)`` key, or a
hash bucket of the key), so a key never spans partitions.  A batch reads back
only the partitions it touches (semi-join on the touched partition values,
pruned at the scan), merges them with the new rows, writes the merged rows
once below the shared checkpoint folder (the final write no longer depends on
the files it replaces), then replaces just those partitions with dynamic
partition overwrite.  Replaying a batch after a failure gives the same table
(the merge is idempotent).  Stream progress lives in the checkpoint location
below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.session import cut_lineage, scratch_path
from furrow.sinks.upsert import upsert


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_partitions(incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence[str],
                      part_cols: Sequence[str]) -> None:
    """Merge ``incoming`` into the partitioned table at ``path``, rewriting
    only the partitions it touches (a semi join on the partition values)."""
    spark = incoming.sparkSession
    part_cols = list(part_cols)
    if _exists(spark, path):
        touched = incoming.select(*part_cols).distinct()
        current = spark.read.parquet(path).join(touched, part_cols, "left_semi")
        merged = upsert(current.select(*incoming.columns), incoming, keys, order, newest_wins=True)
    else:
        merged = upsert(incoming.limit(0), incoming, keys, order, newest_wins=True)
    merged = cut_lineage(merged, "merge")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*part_cols).parquet(path))


def stream_upsert(spark: SparkSession, source_path: str, source_schema: T.StructType, target_path: str,
                  keys: Sequence[str], order: Sequence[str], part_cols: Sequence[str],
                  clean: Callable[[DataFrame], DataFrame] = lambda d: d,
                  checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                  fmt: str = "parquet") -> None:
    """Run the incremental load until every available file is processed.

    ``clean`` must add the ``part_cols`` (derived from the key)."""
    reader = spark.readStream.schema(source_schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_path)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        upsert_partitions(clean(batch), target_path, keys, order, part_cols)

    q = (stream.writeStream.foreachBatch(merge_batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def key_bucket(keys: Sequence[str], buckets: int = 64) -> F.Column:
    """A partition column that is a function of the key (for keys without a date)."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
