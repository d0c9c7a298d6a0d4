"""Keyed upserts without a table format that has MERGE (ops 2.3-2.6, 5.4).

An upsert is a union of the current table and the incoming rows followed by
latest-wins dedup per key (an aggregation with map-side combine, see
``furrow.operators.dedup``).  The result is written to a new location (or
with dynamic partition overwrite of the touched partitions); a plan never
reads and overwrites the same path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.dedup import latest_by_key
from furrow.operators.quality import DataQualityError


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str],
           order: Sequence[str] = ("extraction_date",), seq_col: str = "__load_seq",
           as_of=None, newest_wins: bool = False) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``current`` with the same key,
    also when their ``order`` is older or null (ops 2.3, 2.4); ``order`` picks
    among rows of one side.  ``as_of`` (a column or value) fills a null in the
    first order column of ``incoming``.  ``newest_wins`` compares ``order``
    across both sides first, for loads that may arrive out of order."""
    if as_of is not None:
        kind = incoming.schema[order[0]].dataType
        incoming = incoming.withColumn(order[0], F.coalesce(order[0], (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast(kind)))
    cur = current.withColumn(seq_col, F.lit(0))
    inc = incoming.withColumn(seq_col, F.lit(1))
    both = cur.unionByName(inc, allowMissingColumns=True)
    return latest_by_key(both, keys, [*order, seq_col] if newest_wins else [seq_col, *order]).drop(seq_col)


def pack_metrics_upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str],
                        metrics: Sequence[str], order: Sequence[str] = ("extraction_date",), as_of=None) -> DataFrame:
    """Facts with a JSON ``metrics`` column (op 2.3): incoming metric columns
    are packed (nulls dropped) and upserted on ``keys``."""
    packed = incoming.select(*keys, *order, F.to_json(F.struct(*metrics)).alias("metrics"))
    return upsert(current, packed, keys, order, as_of=as_of)


def versioned_upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str],
                     version_col: str, metrics: Sequence[str], target_col: str,
                     strict: bool = True) -> DataFrame:
    """Forecast upsert keeping every vintage (op 2.5).

    The key includes ``version_col`` (extraction date), so a new vintage adds
    rows and a re-run of the same vintage replaces its own rows.  Rows with a
    null target date or with every metric null are rejected (raise when
    ``strict``, else dropped).
    """
    bad = F.col(target_col).isNull() | F.coalesce(*[F.col(m) for m in metrics]).isNull()
    if strict:
        n_bad = incoming.where(bad).limit(1).count()
        if n_bad:
            raise DataQualityError("forecast rows with null target date or no metric")
    clean = incoming.where(~bad)
    return upsert(current, clean, [*keys, version_col], order=[version_col])


def partial_upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str],
                   update_cols: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert that changes only ``update_cols`` on existing keys (op 2.6).

    New keys are inserted whole; for existing keys every other column keeps
    its current value (current first), the update columns take the incoming
    value (incoming first).  Columns that only ``incoming`` has are added, null
    for the rows it does not hold.  Of incoming rows with one key the last by
    ``order`` counts (by default the last in the frame).
    """
    key = list(key)
    cols = [c for c in [*current.columns, *(c for c in incoming.columns if c not in current.columns)] if c not in key]
    incoming = latest_by_key(incoming.withColumn("__seq", F.monotonically_increasing_id()), key, [*order, "__seq"]).drop("__seq")
    a = current.select(*key, *[F.col(c).alias(f"__a_{c}") for c in cols if c in current.columns], F.lit(True).alias("__a"))
    b = incoming.select(*key, *[F.col(c).alias(f"__b_{c}") for c in cols if c in incoming.columns],
                        F.lit(True).alias("__b"))
    j = a.join(b, key, "full_outer")
    out = []
    for c in cols:
        has_b = c in incoming.columns
        if not has_b:
            out.append(F.col(f"__a_{c}").alias(c))
        elif c not in current.columns:
            out.append(F.col(f"__b_{c}").alias(c))
        elif c in update_cols:
            out.append(F.when(F.col("__b").isNotNull(), F.col(f"__b_{c}")).otherwise(F.col(f"__a_{c}")).alias(c))
        else:
            out.append(F.when(F.col("__a").isNotNull(), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(c))
    return j.select(*key, *out)


def write_upserted(result: DataFrame, path: str, parts: Sequence[str] = ()) -> None:
    """Persist an upsert result; with ``parts`` only the touched partitions are replaced."""
    w = result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
