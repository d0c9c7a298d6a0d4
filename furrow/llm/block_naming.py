"""Exact dedup by deterministic block naming (operator 9).

A text (null: empty; A-Z lower-cased, nothing else changed) is cut into blocks
of fixed size.  Distinct blocks are sorted and numbered; equal blocks get one
integer name.  Then names of adjacent pairs are named in the same way, level
by level, until each document is one name.  A name stands for exactly one byte
string at its level, so equal identities are equal texts: no hash decides.

Scale.  Level 0 moves each block once: a task names the blocks of its own
batch first, so a block shared by a third of all documents leaves a task once
and not once per copy.  Later levels move two integers per pair.  Level names
are joined back with a plain join that AQE can split; the rows of one document
are grouped by (document, position) and never collected.  Every level is
written to the shared checkpoint folder.

Defined cases: null text equals empty text; an empty text has one empty block;
rows that repeat (also the same doc_id twice) are rows of their own; a null
doc_id loses against any other; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import plain, staged, sub_batches, text_bytes

BLOCK_BYTES = 4096

_SPLIT = "chunk long, uid long, doc_id {}, n_bytes long, sha string, names array<int>, name int, block binary"


def _cut(block_bytes: int, id_type: pa.DataType):
    """Per batch: one row per document with the batch-local names of its blocks,
    and one row per distinct block of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sub_batches(whole, "text"):
                uid = b.column("uid").to_pylist()
                local: dict[bytes, int] = {}
                rows, shas, sizes = [], [], []
                for t in b.column("text").to_pylist():
                    t = t.lower()  # of bytes: A-Z only
                    sizes.append(len(t))
                    shas.append(hashlib.sha256(t).hexdigest())
                    rows.append([local.setdefault(t[i:i + block_bytes], len(local))
                                 for i in range(0, max(len(t), 1), block_bytes)])
                n, m = b.num_rows, len(local)
                none = lambda t, k: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([
                    pa.array([uid[0]] * n, pa.int64()), b.column("uid"), b.column("doc_id").cast(id_type),
                    pa.array(sizes, pa.int64()), pa.array(shas), pa.array(rows, pa.list_(pa.int32())),
                    none(pa.int32(), n), none(pa.binary(), n)], names=_NAMES)
                yield pa.RecordBatch.from_arrays([
                    pa.array([uid[0]] * m, pa.int64()), none(pa.int64(), m), none(id_type, m), none(pa.int64(), m),
                    none(pa.string(), m), none(pa.list_(pa.int32()), m),
                    pa.array(range(m), pa.int32()), pa.array(list(local), pa.binary())], names=_NAMES)
    return run


_NAMES = ["chunk", "uid", "doc_id", "n_bytes", "sha", "names", "name", "block"]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for sorted blocks: one integer per run of equal blocks.  Equal
    blocks are in one partition, whose number leads the name."""
    from pyspark import TaskContext

    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for b in batches:
        if not b.num_rows:
            continue
        blocks = b.column("block")
        new = np.ones(b.num_rows, dtype=np.int64)
        new[1:] = pc.not_equal(blocks.slice(1), blocks.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or blocks[0].as_py() != last
        names = name + np.cumsum(new)
        name, last = int(names[-1]), blocks[-1].as_py()
        yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("name"), pa.array(names)], names=["chunk", "local", "name"])


def identities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, n_bytes, sha, level, name) per row of ``docs``; rows hold
    equal (level, name) if and only if their normalised texts are equal."""
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(plain(id_col)[0].alias("doc_id"), text_bytes(f"`{text_col}`").alias("text")) \
        .withColumn("uid", F.monotonically_increasing_id())
    cut = staged(src.mapInArrow(_cut(block_bytes, to_arrow_type(kind)), _SPLIT.format(kind.simpleString())), "blocks")
    rows = cut.where("block IS NULL").select("chunk", "uid", "doc_id", "n_bytes", "sha", "names")
    named = cut.where("block IS NOT NULL").select("chunk", "name", "block") \
        .repartition("block").sortWithinPartitions("block") \
        .mapInArrow(_number, "chunk long, local int, name long")
    named = staged(named, "block-names")
    seq = rows.select("chunk", "uid", F.size("names").alias("n"), F.posexplode("names").alias("idx", "local")) \
        .join(named, ["chunk", "local"]).select("uid", "n", "idx", "name")
    seq = staged(seq, "names-0")
    done = [seq.where("n = 1").select("uid", F.lit(0).alias("level"), "name")]
    most = seq.agg(F.max("n")).first()[0] or 1
    for level in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        pairs = seq.where("n > 1").groupBy("uid", "n", F.shiftright("idx", 1).alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
        pairs = pairs.select("uid", F.shiftright(F.col("n") + 1, 1).alias("n"), "idx", "a", "b")
        pairs = staged(pairs, f"pairs-{level}")
        names = staged(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
                       .select("a", "b", F.monotonically_increasing_id().alias("name")), f"pair-names-{level}")
        seq = staged(pairs.join(names, ["a", "b"]).select("uid", "n", "idx", "name"), f"names-{level}")
        done.append(seq.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    return rows.select("uid", "doc_id", "n_bytes", "sha").join(ident, "uid")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the largest doc_id of the
    equal texts), group_size, kept, text_sha256, n_bytes, level, name.  Of rows
    that share the kept doc_id and text, all are marked kept."""
    ident = staged(identities(docs, text_col, id_col, block_bytes), "identities")
    groups = staged(ident.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ident.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), "n_bytes", "level", "name")
