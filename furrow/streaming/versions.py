"""Incremental tables with versions (op 10.1): batches switch whole or not at all.

A table folder holds ``data/<generation>/p=<partition>/`` with immutable Parquet
files and ``log/<version>.json``, one small record per version: the batch that
made it and, for every partition, the generation that counts.  A batch reads the
partitions it touches, merges them by key, writes a generation of its own and then
puts the next record in place with a rename that fails if the name exists: that
rename is the switch.  A batch that dies before it leaves files that no record
names; its replay merges again.  A batch that was switched already is skipped, so
a stream that restarts at any point loses and repeats nothing.  Two writers cannot
both put the same version: the loser merges again on top of the winner's.

Only the touched partitions are read and written (a day of facts for a daily
load); what the driver holds is one entry per partition.  The file system must
rename within a folder in one step (HDFS, ABFS, local).

``stream_merge`` runs it as a stream; ``fill_batch`` carries forward fills over
batches with a state table of the last known values per key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.dedup import latest_by_key
from furrow.operators.fill import ffill
from furrow.session import scratch_path
from furrow.sinks.upsert import upsert

NULL_PART = "null"


class _Folder:
    """Small files of the log, through the session's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, sub: str) -> list[str]:
        at = self._at(f"{self.path}/{sub}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Whole file in one step; False if the name is taken."""
        at, draft = self._at(f"{self.path}/{name}"), self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            return False
        return True

    def drop(self, sub: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{sub}"), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(int(n[:-5]) for n in _Folder(spark, path).names("log") if n.endswith(".json"))


def _record(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    if version not in known:
        return {"version": 0, "batches": {}, "parts": {}, "schema": None}
    return json.loads(_Folder(spark, path).read(f"log/{version:012d}.json"))


def read_version(spark: SparkSession, path: str, version: int | None = None,
                 parts: Callable[[str], bool] | Sequence[str] | None = None) -> DataFrame:
    """The table as of ``version`` (the newest if None).  ``parts`` keeps the
    partitions whose name it accepts or holds: the files of others are not opened."""
    rec = _record(spark, path, version)
    if rec["schema"] is None:
        raise FileNotFoundError(f"no version {version or ''} of a table at {path}")
    return _read(spark, path, rec, parts)


def _read(spark: SparkSession, path: str, rec: dict, parts=None) -> DataFrame:
    schema = T.StructType.fromJson(rec["schema"])
    keep = (lambda p: True) if parts is None else parts if callable(parts) else set(parts).__contains__
    folders = [f"{path.rstrip('/')}/data/{gen}/p={p}" for p, gen in sorted(rec["parts"].items()) if gen and keep(p)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def part_name(part_col: str) -> F.Column:
    """A partition's name: the value as text, other characters than letters, digits, ``-`` and ``_`` as their code."""
    text = F.coalesce(F.col(part_col).cast("string"), F.lit(NULL_PART))
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9_-]?$"), c).otherwise(F.concat(F.lit("~"), F.hex(c), F.lit("~"))))
    return F.when(text.rlike("^[A-Za-z0-9_-]+$"), text).otherwise(F.concat(F.lit("~"), F.concat_ws("", chars)))


def merge_batch(incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], part_col: str,
                batch: int | None = None, stream: str = "stream", tries: int = 5) -> int:
    """Merge ``incoming`` by ``keys`` (latest by ``order`` wins, also against rows
    of the table) and switch to the next version; returns the version that holds
    the batch.  ``part_col`` must be a function of the keys.  A ``batch`` number of
    ``stream`` that is not above the last one committed is left alone."""
    spark = incoming.sparkSession
    # the batch by key first: what is merged and shuffled again is one row per key
    batch_rows = latest_by_key(incoming, list(keys), list(order)).withColumn("p", part_name(part_col))
    touched = None
    for _ in range(tries):
        rec = _record(spark, path)
        if batch is not None and rec["batches"].get(stream, -1) >= batch:
            return rec["version"]
        if touched is None:
            touched = sorted(r.p for r in batch_rows.select("p").distinct().collect())
        old = [p for p in touched if p in rec["parts"]]
        merged = batch_rows
        if old:
            merged = upsert(_read(spark, path, rec, old), incoming, keys, order, newest_wins=True).withColumn("p", part_name(part_col))
        gen = f"{rec['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        # AQE splits a hot day over several files and puts small ones together
        merged.hint("rebalance", "p").write.partitionBy("p").parquet(f"{path.rstrip('/')}/data/{gen}")
        new = {"version": rec["version"] + 1, "batches": {**rec["batches"], **({stream: batch} if batch is not None else {})},
               "parts": {**rec["parts"], **dict.fromkeys(touched, gen)}, "schema": merged.drop("p").schema.jsonValue()}
        if _commit(spark, path, new):
            return new["version"]
    raise RuntimeError(f"{tries} other writers were faster at {path}")


def _commit(spark: SparkSession, path: str, rec: dict) -> bool:
    return _Folder(spark, path).put(f"log/{rec['version']:012d}.json", json.dumps(rec, sort_keys=True))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete generations that none of the newest ``keep`` versions names, and
    older records; returns the generations.  Not while a batch is being written."""
    folder, known = _Folder(spark, path), versions(spark, path)
    used = {gen for v in known[-keep:] for gen in _record(spark, path, v)["parts"].values()}
    gone = sorted(g for g in folder.names("data") if g not in used)
    for v in known[:-keep]:
        folder.drop(f"log/{v:012d}.json")
    for g in gone:
        folder.drop(f"data/{g}")
    return gone


def stream_merge(spark: SparkSession, source_path: str, source_schema: T.StructType, path: str, keys: Sequence[str], order: Sequence[str], part_col: str,
                 clean: Callable[[DataFrame], DataFrame] = lambda d: d, checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None, fmt: str = "parquet",
                 each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Merge every landed file into the table at ``path``, then stop.  ``each``
    (batch, number) takes the place of ``merge_batch``."""
    reader = spark.readStream.schema(source_schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def run(batch: DataFrame, number: int) -> None:
        if each:
            each(clean(batch), number)
        else:
            merge_batch(clean(batch), path, keys, order, part_col, batch=number)

    reader.load(source_path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")) \
        .trigger(availableNow=True).start().awaitTermination()


def fill_batch(batch: DataFrame, path: str, keys: Sequence[str], at: str, values: Sequence[str], part_col: str,
               number: int | None = None, buckets: int = 16) -> None:
    """Forward-filled facts, batch by batch (op 6.5 over increments).

    ``path/facts`` keeps the rows, unique by ``keys`` and ``at``, with a column
    ``<value>_filled`` per value; ``path/state`` keeps, per key, the last ``at``
    and the last known values.  Rows behind a key's state are filled from it.  A
    key with a late row (not behind its state) has its rows filled anew from the
    stored facts, so that the table always equals the fill of all rows at once.
    Facts switch before the state: a replay after a stop between the two finds the
    facts committed, computes the same rows and commits the state."""
    spark, keys, values = batch.sparkSession, list(keys), list(values)
    raw = [*keys, at, *values, *([part_col] if part_col not in (*keys, at) else [])]
    batch = latest_by_key(batch.select(*raw), [*keys, at], values)
    facts, state = f"{path.rstrip('/')}/facts", f"{path.rstrip('/')}/state"
    carried = [F.col(f"last_{c}").alias(c) for c in (at, *values)]
    if versions(spark, state):
        before = read_version(spark, state).select(*keys, F.col(at).alias(f"last_{at}"), *[F.col(v).alias(f"last_{v}") for v in values])
        late = batch.join(before, keys).where(F.col(at) <= F.col(f"last_{at}")).select(*keys).distinct()
        history = _read(spark, facts, _record(spark, facts)).select(*raw).join(late, keys, "left_semi")
        known = upsert(history, batch, [*keys, at], values) if versions(spark, facts) else batch
        on_time = before.join(batch.select(*keys).distinct(), keys, "left_semi").join(late, keys, "left_anti")
        rows = known.withColumn("carry", F.lit(False)).unionByName(
            on_time.select(*keys, *carried, F.lit(True).alias("carry")), allowMissingColumns=True)
    else:
        rows = batch.withColumn("carry", F.lit(False))
    filled = ffill(rows.select("*", *[F.col(v).alias(f"{v}_filled") for v in values]), keys, [at], [f"{v}_filled" for v in values], chunk="range")
    filled = filled.where("NOT carry").drop("carry").withColumn("batch", F.lit(number or 0).cast("long"))
    merge_batch(filled, facts, [*keys, at], ["batch"], part_col, batch=number)
    ends = filled.groupBy(*keys).agg(F.max_by(F.struct(at, *[F.col(f"{v}_filled").alias(v) for v in values]), at).alias("s")).select(*keys, "s.*")
    ends = ends.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    merge_batch(ends, state, keys, [at], "bucket", batch=number)
