"""Explicit skew handling for joins (when AQE's runtime skew split cannot apply,
e.g. the small side is too large to broadcast and one key holds a large share
of the big side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                buckets: int = 16) -> DataFrame:
    """Join on ``keys`` with the big side's rows spread over ``buckets`` salt
    values (a hash of the whole row, deterministic on retry) and the small side
    repeated once per salt value.  Each big row still meets every small row of
    its key exactly once, so inner and left results are unchanged, while a hot
    key is processed by up to ``buckets`` tasks instead of one."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = list(keys)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(buckets)).cast("int")
    b = big.withColumn("__salt", salt)
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, [*keys, "__salt"], how).drop("__salt")
