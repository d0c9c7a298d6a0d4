"""Gap filling over ordered series (ops 6.3-6.6, 6.8).

Every fill needs, for each row, the nearest non-null value at or before it
and at or after it, with their row positions.  ``neighbors`` computes them as
a segmented scan so that no series has to fit in one task:

1. rows are windowed per ``(keys, chunk)``, where ``chunk`` is a column that
   never decreases along ``order`` (a day, an hour, a block of turns); each
   chunk yields its local neighbours and local positions;
2. a per-chunk summary (row count, first/last non-null with its position)
   is a tiny table, one row per chunk; a window over it per key carries
   the last non-null forward and the first non-null backward across chunks
   and gives each chunk its row offset;
3. the summary is joined back on ``(keys, chunk)``; the big side keeps the
   partitioning it already has from step 1.

Without ``chunk`` the window runs per key directly (fine when a key's series
is bounded, e.g. one location-year of daily rows).  ``chunk="range"`` picks
chunks from the data: range partitions of (keys, order), so even a key that
holds a third of all rows is cut into bounded pieces.

The summary branch reads only keys, chunk, order and value columns.  When
the input is a table scan, Spark reuses the step-1 shuffle for it or runs a
narrower second scan.  When the input is an expensive derived frame (a big
aggregation), pass ``checkpoint_input=True`` to materialise it once in the
shared checkpoint folder instead of computing it for both branches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ranges import range_tasks
from furrow.session import cut_lineage

_UNB_P, _CUR = Window.unboundedPreceding, Window.currentRow


def _names(v: str) -> dict[str, str]:
    return {k: f"__{k}_{v}" for k in ("prev", "prev_pos", "next", "next_pos")}


def neighbors(df: DataFrame, keys: Sequence[str], order: Sequence, values: Sequence[str],
              chunk: Column | str | None = None, pos_col: str = "__pos",
              strict: bool = False, checkpoint_input: bool = False) -> DataFrame:
    """Adds ``pos_col`` (1-based row position within the key) and, per value
    column ``v``: ``__prev_v``, ``__prev_pos_v``, ``__next_v``, ``__next_pos_v``.
    Prev/next include the row itself when it is non-null, unless ``strict``."""
    keys = list(keys)
    order = list(order)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        base = df.withColumn(pos_col, F.row_number().over(w).cast("long"))
        back = Window.partitionBy(*keys).orderBy(F.col(pos_col).desc())
        return base.select("*", *_local_cols(w, back, values, pos_col, strict))

    ck = "__chunk"
    if isinstance(chunk, str) and chunk == "range":
        # data-adaptive chunks: range partitions of (keys, order) split even one
        # hot key into bounded pieces, and their index grows with the order
        # inside a key.  Written once so both branches see the same chunk ids.
        # Their number follows the bytes.
        ranged = df.repartitionByRange(range_tasks(df), *[F.col(k) for k in keys], *[_as_order(o) for o in order])
        df = cut_lineage(ranged.withColumn("__range", F.spark_partition_id()), "fill-ranges")
        chunk_c = F.col("__range")
    else:
        chunk_c = chunk if isinstance(chunk, Column) else F.col(chunk)
        if checkpoint_input:
            df = cut_lineage(df)
    wl = Window.partitionBy(*keys, ck).orderBy(*order)
    step1 = df.withColumn(ck, chunk_c).withColumn("__lpos", F.row_number().over(wl).cast("long"))
    back = Window.partitionBy(*keys, ck).orderBy(F.col("__lpos").desc())
    local = step1.select("*", *_local_cols(wl, back, values, "__lpos", strict))

    # per-chunk summary: one row per (keys, chunk)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for v in values:
        nn = F.when(F.col(v).isNotNull(), F.struct(F.col("__lpos").alias("p"), F.col(v).alias("v")))
        aggs += [F.max(nn).alias(f"__last_{v}"), F.min(nn).alias(f"__first_{v}")]
    summ = local.groupBy(*keys, ck).agg(*aggs)
    ws, wr = Window.partitionBy(*keys).orderBy(ck), Window.partitionBy(*keys).orderBy(F.col(ck).desc())
    summ = summ.withColumn("__off", F.coalesce(F.sum("__n").over(ws.rowsBetween(_UNB_P, -1)), F.lit(0)))
    carried = []
    for v in values:
        glast = F.when(F.col(f"__last_{v}").isNotNull(),
                       F.struct((F.col("__off") + F.col(f"__last_{v}.p")).alias("p"), F.col(f"__last_{v}.v").alias("v")))
        gfirst = F.when(F.col(f"__first_{v}").isNotNull(),
                        F.struct((F.col("__off") + F.col(f"__first_{v}.p")).alias("p"), F.col(f"__first_{v}.v").alias("v")))
        carried += [F.last(glast, ignorenulls=True).over(ws.rowsBetween(_UNB_P, -1)).alias(f"__cin_{v}"),
                    F.last(gfirst, ignorenulls=True).over(wr.rowsBetween(_UNB_P, -1)).alias(f"__cout_{v}")]
    summ = summ.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col(ck).alias("__s_chunk"),
                       "__off", *carried)

    # Null-safe keys: no inferred not-null filter lands on one branch only, so
    # both branches keep the same shuffle of the input, which Spark reuses.
    cond = None
    for k in [*keys, ck]:
        c = F.col(k).eqNullSafe(F.col(f"__s_{k}" if k != ck else "__s_chunk"))
        cond = c if cond is None else cond & c
    joined = local.join(summ, cond, "left")
    out_cols = [c for c in df.columns if c != "__range"]
    sel = [*[F.col(c) for c in out_cols], (F.col("__off") + F.col("__lpos")).alias(pos_col)]
    for v in values:
        n = _names(v)
        has_prev = F.col(n["prev_pos"]).isNotNull()
        has_next = F.col(n["next_pos"]).isNotNull()
        sel += [
            F.when(has_prev, F.col(n["prev"])).otherwise(F.col(f"__cin_{v}.v")).alias(n["prev"]),
            F.when(has_prev, F.col("__off") + F.col(n["prev_pos"])).otherwise(F.col(f"__cin_{v}.p")).alias(n["prev_pos"]),
            F.when(has_next, F.col(n["next"])).otherwise(F.col(f"__cout_{v}.v")).alias(n["next"]),
            F.when(has_next, F.col("__off") + F.col(n["next_pos"])).otherwise(F.col(f"__cout_{v}.p")).alias(n["next_pos"]),
        ]
    return joined.select(*sel)


def _as_order(o) -> Column:
    return o if isinstance(o, Column) else F.col(o)


def _local_cols(w, reverse, values: Sequence[str], pos: str, strict: bool = False) -> list[Column]:
    """"Next" is the last value in the reversed order: a growing frame, which
    Spark evaluates in one pass, where a frame that shrinks is evaluated anew
    for every row."""
    back = w.rowsBetween(_UNB_P, -1 if strict else _CUR)
    fwd = reverse.rowsBetween(_UNB_P, -1 if strict else _CUR)
    cols = []
    for v in values:
        n = _names(v)
        at = F.when(F.col(v).isNotNull(), F.col(pos))
        cols += [F.last(v, ignorenulls=True).over(back).alias(n["prev"]),
                 F.last(at, ignorenulls=True).over(back).alias(n["prev_pos"]),
                 F.last(v, ignorenulls=True).over(fwd).alias(n["next"]),
                 F.last(at, ignorenulls=True).over(fwd).alias(n["next_pos"])]
    return cols


def _finish(nb: DataFrame, columns: Sequence[str], exprs: dict[str, Column]) -> DataFrame:
    """Back to the input's columns, filled columns replaced."""
    return nb.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in columns])


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: Sequence, values: Sequence[str],
                       chunk=None, checkpoint_input: bool = False) -> DataFrame:
    """Linear interpolation by row position; leading and trailing gaps take the
    nearest value; an all-null series stays null (op 6.3)."""
    nb = neighbors(df, keys, order, values, chunk, checkpoint_input=checkpoint_input)
    exprs = {}
    for v in values:
        n = _names(v)
        p, q = F.col(n["prev"]), F.col(n["next"])
        ip, iq = F.col(n["prev_pos"]), F.col(n["next_pos"])
        slope = (q - p) / (iq - ip).cast("double")
        exprs[v] = (F.when(F.col(v).isNotNull(), F.col(v))
                    .when(p.isNull(), q).when(q.isNull(), p)
                    .otherwise(p + slope * (F.col("__pos") - ip).cast("double")))
    return _finish(nb, df.columns, exprs)


def ffill(df: DataFrame, keys: Sequence[str], order: Sequence, values: Sequence[str], chunk=None,
          checkpoint_input: bool = False) -> DataFrame:
    """Forward fill only; leading nulls stay null (op 6.5)."""
    nb = neighbors(df, keys, order, values, chunk, checkpoint_input=checkpoint_input)
    return _finish(nb, df.columns, {v: F.col(_names(v)["prev"]) for v in values})


def ffill_bfill(df: DataFrame, keys: Sequence[str], order: Sequence, values: Sequence[str], chunk=None,
                checkpoint_input: bool = False) -> DataFrame:
    """Forward fill, then backward fill the leading gap (op 6.4)."""
    nb = neighbors(df, keys, order, values, chunk, checkpoint_input=checkpoint_input)
    return _finish(nb, df.columns, {v: F.coalesce(F.col(_names(v)["prev"]), F.col(_names(v)["next"]))
                                    for v in values})


def carry_forward_before(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str,
                         chunk=None) -> DataFrame:
    """``out`` = latest non-null ``value`` strictly before each row (ops 6.6, 6.8)."""
    return carry_all_before(df, keys, order, {value: out}, chunk)


def carry_all_before(df: DataFrame, keys: Sequence[str], order: Sequence, outs: Mapping[str, str], chunk=None) -> DataFrame:
    """``carry_forward_before`` of several columns ({value: out}) in one scan of the series."""
    nb = neighbors(df, keys, order, list(outs), chunk, strict=True)
    return nb.select(*df.columns, *[F.col(_names(v)["prev"]).alias(out) for v, out in outs.items()])
