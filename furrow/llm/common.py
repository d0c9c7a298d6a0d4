"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.session import scratch_path

#: bytes of a lower-cased word: digits, a-z and everything beyond ASCII
WORD_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and continue from the
    files: later jobs and retries read them instead of repeating the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``staged`` that no later step reads."""
    from pyarrow import fs

    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        try:
            where, path = fs.FileSystem.from_uri(folder)
            where.delete_dir(path)
        except (OSError, pa.ArrowException):
            pass  # scratch that cannot be reached from the driver stays until the folder is cleaned


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (u, v): the smallest node that
    links reach.  Each round hooks every node to its smallest neighbour, follows
    the hooks to their ends by doubling and contracts the edges: what is left are
    ends, at most half as many nodes, whatever the order of ids on a path.  A
    hub's neighbours are combined in the tasks before they meet, and joins are
    open to AQE's split."""
    now, parents = staged(edges.where("u <> v").distinct(), "edges"), []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = _ends(staged(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("p")), "hooks"))
        parents.append(parent)
        left, right = parent.toDF("u", "pu"), parent.toDF("v", "pv")
        now = staged(now.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    if not parents:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("label")).where("false")
    out = parents[-1].toDF("node", "label")
    for parent in reversed(parents[:-1]):
        step = parent.toDF("node", "mid").join(out.toDF("mid", "top"), "mid", "left")
        out = staged(step.select("node", F.coalesce("top", "mid").alias("label")), "labels")
    return out


def _ends(parent: DataFrame) -> DataFrame:
    """(u, p) with p followed to the end of its chain of hooks, four hooks a step
    of the chains that the step before left: a hook leads to a smaller node."""
    while True:
        two = parent.join(parent.toDF("p", "q"), "p").select("u", F.col("p").alias("one"), F.col("q").alias("p"))
        four = two.join(two.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("one")).alias("moved"))
        four = staged(four, "ends")
        parent = four.select("u", "p")
        if four.where("moved").isEmpty():
            return parent


def text_bytes(col: str = "text"):
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan(df: DataFrame, group: str, order: list[str], folder: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = (),
         by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Running figures within groups of any size, in two phases.

    ``group`` is a long or int column without nulls.  Rows are range-partitioned
    and sorted by (group, order, row number), so that a group of any size is cut
    over tasks.  Each task numbers its rows per group and runs the ``sums`` and
    ``xors`` (long columns without nulls); the rows are written below ``folder``
    with these local figures (columns piece, at, ordinal, run_*), the second
    table returned brings what earlier tasks add: one row per task.  ``settle``
    puts both together."""
    spark = df.sparkSession
    tie = fresh(df, "tie")
    cols = df.columns
    sorted_rows = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in (group, *order, tie)]
    runs = [f"run_{c}" for c in (*sums, *xors)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{c} long" for c in ("piece", "at", "ordinal", *runs)])
    local = sorted_rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*plain(*cols)) \
        .mapInArrow(_scan_task(cols, group, tuple(sums), tuple(xors)), schema)
    write = local.write.option("compression", "zstd")
    (write.partitionBy(*by) if by else write).parquet(f"{folder}/rows")
    rows = spark.read.schema(local.schema).parquet(f"{folder}/rows")
    g = F.col(f"`{group}`")
    last = rows.groupBy("piece").agg(F.min(g).cast("long").alias("first"), F.max(F.struct(g.cast("long").alias("g"), "at", "ordinal", *runs)).alias("m"))
    last = last.select("piece", "first", F.col("m.g").alias("last"), (F.col("m.at") + 1).alias("n"), F.col("m.ordinal").alias("groups"), *[F.col(f"m.{r}").alias(r) for r in runs])
    # a question (where a task's first group stands) and an answer (what its last group holds) per task, by group
    zero = [F.lit(0).cast("long").alias(c) for c in ("n", *runs)]
    events = last.select(F.col("first").alias("g"), "piece", F.lit(0).alias("kind"), *zero).unionByName(
        last.select(F.col("last").alias("g"), "piece", F.lit(1).alias("kind"), "n", *runs))
    before = Window.partitionBy("g").orderBy("piece", "kind").rowsBetween(Window.unboundedPreceding, -1)
    total = [(F.bit_xor if r in {f"run_{c}" for c in xors} else F.sum)(r).over(before).alias(f"add_{r}") for r in runs]
    held = events.select("piece", "kind", F.sum("n").over(before).alias("add_at"), *total).where("kind = 0").drop("kind")
    in_order = Window.orderBy("piece")
    new = last.select("piece", "first", (F.col("groups") + 1 - F.coalesce((F.col("first") == F.lag("last").over(in_order)).cast("int"), F.lit(0))).alias("new"),
                      (F.coalesce((F.col("first") == F.lag("last").over(in_order)).cast("int"), F.lit(0))).alias("goes_on"))
    ahead = new.select("piece", "first", (F.coalesce(F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("goes_on")).alias("add_ordinal"))
    ahead.join(held, "piece").coalesce(1).write.parquet(f"{folder}/pieces")
    return rows, spark.read.parquet(f"{folder}/pieces")


def settle(rows: DataFrame, pieces: DataFrame, group: str, xors: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``scan`` with whole figures: at (place in the group, from 0),
    ordinal (number of the group, from 0) and run_* (this row included).  The
    table that is broadcast has one row of some 60 bytes per task."""
    runs = [c for c in pieces.columns if c.startswith("add_run_")]
    at_first = F.col(f"`{group}`").cast("long") == F.col("first")

    def more(c: str):
        add = F.when(at_first, F.coalesce(F.col(f"add_{c}"), F.lit(0))).otherwise(F.lit(0))
        return F.col(c).bitwiseXOR(add) if c in {f"run_{x}" for x in xors} else F.col(c) + add

    keep = [c for c in rows.columns if c not in {"piece", "at", "ordinal", *[r[4:] for r in runs]}]
    return rows.join(F.broadcast(pieces), "piece").select(
        *plain(*keep), more("at").alias("at"), (F.col("ordinal") + F.col("add_ordinal")).alias("ordinal"), *[more(r[4:]).alias(r[4:]) for r in runs])


def running(df: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), name: str = "running") -> DataFrame:
    """``scan`` and ``settle`` in a fresh folder."""
    rows, pieces = scan(df, group, order, scratch_path(df.sparkSession, name), sums, xors)
    return settle(rows, pieces, group, xors)


def _scan_task(cols: list[str], group: str, sums: tuple[str, ...], xors: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, now, ordinal, carry = TaskContext.get().partitionId(), None, -1, [0] * (1 + len(sums) + len(xors))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(cols.index(group)).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = now is None or int(g[0]) != now
            here = np.arange(n, dtype=np.int64)
            begin = np.maximum.accumulate(np.where(new, here, 0))
            goes_on = np.cumsum(new) == 0
            out = [here - begin + np.where(goes_on, carry[0], 0)]
            for k, c in enumerate((*sums, *xors), 1):
                v = b.column(cols.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                if k <= len(sums):
                    total = np.cumsum(v)
                    out.append(total - (total - v)[begin] + np.where(goes_on, carry[k], 0))
                else:
                    total = np.bitwise_xor.accumulate(v)
                    out.append(total ^ (total ^ v)[begin] ^ np.where(goes_on, carry[k], 0))
            number = ordinal + np.cumsum(new)
            now, ordinal, carry = int(g[-1]), int(number[-1]), [int(out[0][-1]) + 1, *[int(x[-1]) for x in out[1:]]]
            extra = [np.full(n, piece, np.int64), out[0], number, *out[1:]]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra)],
                                             names=[*cols, "piece", "at", "ordinal", *[f"run_{c}" for c in (*sums, *xors)]])
    return run


def plain(*names: str):
    """Columns by exact name, whatever characters the names hold."""
    return [F.col(f"`{n}`") for n in names]


def sub_batches(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch whose ``column`` holds about ``max_bytes`` at
    most (one row at least), so that what a task derives from it stays bounded."""
    arr = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    size = np.diff(np.frombuffer(arr.buffers()[1], dtype=np.int32 if not pa.types.is_large_binary(arr.type) else np.int64,
                                 count=arr.offset + len(arr) + 1)[arr.offset:]).astype(np.int64)
    part = (np.cumsum(size) - size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each pair."""
    total = int(lens.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts.astype(np.int64) - (np.cumsum(lens) - lens), lens)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_with_id(docs: DataFrame, ids: DataFrame, id_col: str, keep: bool) -> DataFrame:
    """Rows of ``docs`` whose ``id_col`` is among the one column of ``ids`` (or is
    not, without ``keep``); null equals null, any further columns stay."""
    name = free_name(docs, "__id")
    found = ids.toDF(name).distinct()
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi" if keep else "left_anti")
