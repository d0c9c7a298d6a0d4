"""Key-based dedup (ops 5.4, 5.5, 5.6, 5.12).

Both flavours are aggregations, not windows: ``max``/``min`` of a struct whose
leading fields are the ordering columns picks one whole row per key, and
Spark computes it with a map-side partial aggregate, so a hot key is reduced
inside every task before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordered = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    best = pick(F.struct(*ordered, *[F.col(c) for c in rest])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest ``order`` tuple wins (latest wins, op 5.4).
    Use a load sequence as the last order column to break exact ties."""
    return _pick(df, keys, order, F.max)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest ``order`` tuple wins ("keep first", op 5.5)."""
    return _pick(df, keys, order, F.min)


def distinct_sorted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values, range-sorted (ops 5.6, 7.3)."""
    return df.select(*cols).distinct().orderBy(*cols)


def any_match_dedup(df: DataFrame, id_col: str, conds: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows matching any named condition, one per id (the smallest by the other
    columns in order), and per condition the number of ids that match (op 5.12)."""
    hits = {f"__hit{i}": c for i, c in enumerate(conds.values())}
    tagged = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in hits.items()})
    any_hit = F.greatest(*[F.col(k) for k in hits]) if len(hits) > 1 else F.col("__hit0")
    rows = first_by_key(tagged.where(any_hit).drop(*hits), [id_col], [c for c in df.columns if c != id_col])
    once = tagged.groupBy(id_col).agg(*[F.bool_or(k).alias(k) for k in hits])
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(name)) for k, name in zip(hits, conds)])))
    return rows, once.select(named.alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
