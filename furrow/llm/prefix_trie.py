"""Prefix trie of conversations by vertical bitmaps (operator 13).

A node is a distinct sequence of first turns; its members are the conversations
that start with it.  Conversations are numbered in id order and cut into shards
of ``SHARD`` consecutive ones.  In a shard an index holds, per (position, turn),
the bitset of its conversations.  A depth-first walk starts with the bitset of
all; the lowest conversation left in a node's bitset names the next turn, the
intersection with that turn's posting is a child, and what the child takes is
taken off, so that a node costs one intersection per child.  The population count
gives a node's members, the lowest bit its smallest one, the intersection with
the conversations that stop there the end list.

Shards are merged by node name: the exclusive-or of the 64-bit hashes of its
(position, turn) items, twice with different seeds (128 bits; two nodes share a
name with a probability below n * n / 2**128).  A very long conversation does not
fill a task either: shards are cut into stretches of ``STRETCH`` positions, whose
walks start from the names of the prefixes before them.

Subtree figures need no walk over the whole trie: nodes with one smallest member
are a chain, from some depth down to that conversation's end.  Chains form a tree
of at most as many as conversations; their sums are gathered by pointer doubling
(rounds grow with the logarithm of its depth), and within a chain by a running
sum from the deep end.  Every end list is hashed as a stream of the shards' lists
in order: a third of all conversations in one list is read in pieces.

Defined cases: rows with a null conv_id belong to no conversation and are left
out; conversations are ordered by turn (null first), turns of one number by the
hashes of role and text, the same in every run; null role or text is empty; turnless conversations are members of the root; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import running, staged

SHARD = 2048
STRETCH = 256
_WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(convs: DataFrame, conv_col: str = "conv_id", turn: Column | None = None) -> DataFrame:
    """(conv_id, turn, t1, t2, words): a turn's place, its name of two hashes
    and the words of its text.  Texts themselves are never shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return convs.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), (F.col("turn") if turn is None else turn).cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))


def numbered(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``turns`` and one row (depth 0) per conversation, with depth and number of
    the conversation.  ``ids`` (conv_id) may add conversations without turns."""
    heads = (turns if ids is None else ids).select("conv_id").distinct()
    heads = heads.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "words")])
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "t1", "t2", "words")
    return running(heads.unionByName(rows), "conv_id", ["kind", "turn", "t1", "t2"], name="turns").withColumnsRenamed({"at": "depth", "ordinal": "number"})


def _walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one stretch of one shard."""
    stretch, out = int(key[1]), []
    base = stretch * STRETCH
    number = np.sort(pdf["number"].unique())
    ids = dict(zip(pdf["number"].tolist(), pdf["conv_id"].tolist()))
    conv = [ids[n] for n in number.tolist()]
    rows = pdf.assign(local=np.searchsorted(number, pdf["number"].to_numpy()))
    turns = rows[rows["kind"] == 1]
    # the vertical index: (position, turn) to the bitset of its conversations
    postings: dict[tuple, int] = {}
    turn_at: dict[tuple, tuple] = {}
    reach: dict[int, int] = {}
    items = {}
    for c, d, t1, t2, z1, z2, w in zip(*(turns[x].tolist() for x in ("local", "depth", "t1", "t2", "z1", "z2", "words"))):
        item = (d, t1, t2)
        postings[item] = postings.get(item, 0) | 1 << c
        turn_at[d, c] = item
        reach[d] = reach.get(d, 0) | 1 << c
        items[item] = (z1, z2, w)
    goes_on = 0
    for c in rows.loc[rows["kind"] == 2, "local"].tolist():
        goes_on |= 1 << c
    roots: dict[tuple, int] = {}
    for c, p1, p2 in zip(*(rows.loc[rows["kind"] == 0, x].tolist() for x in ("local", "z1", "z2"))):
        roots[p1, p2] = roots.get((p1, p2), 0) | 1 << c
    stack = [(bits, base, p1, p2, 0, 0, 0) for (p1, p2), bits in roots.items()]
    while stack:
        bits, depth, p1, p2, q1, q2, words = stack.pop()
        deeper = goes_on if depth == base + STRETCH else reach.get(depth + 1, 0)
        rest = bits & deeper
        if depth > base or not base:  # a later stretch starts below a node that the one before has given
            ended = bits & ~deeper
            out.append((p1, p2, depth, q1, q2, bits.bit_count(), conv[(bits & -bits).bit_length() - 1], words,
                        ",".join(str(conv[i]) for i in _members(ended)) if ended else None))
        if depth == base + STRETCH:
            continue
        while rest:
            item = turn_at[depth + 1, (rest & -rest).bit_length() - 1]
            child = rest & postings[item]
            rest ^= child
            z1, z2, w = items[item]
            stack.append((child, depth + 1, p1 ^ z1, p2 ^ z2, p1, p2, w))
    frame = pd.DataFrame(out, columns=["p1", "p2", "depth", "q1", "q2", "n", "conv_id", "words", "ends"])
    return frame.assign(shard=int(key[0]))


def _members(bits: int) -> Iterator[int]:
    raw = np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")
    return iter(np.flatnonzero(raw).tolist())


def shard_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of every shard: name (p1, p2), depth, parent's name (q1, q2),
    members n, smallest member, words of the last text, end list, shard."""
    z = [F.xxhash64(F.lit(s), "depth", "t1", "t2").alias(f"z{s - 2}") for s in (3, 4)]
    at = rows.select("conv_id", "number", "kind", "depth", "t1", "t2", "words", *z)
    shard = F.floor(F.col("number") / SHARD).alias("shard")
    cols = ["shard", "stretch", "kind", "number", "conv_id", "depth", "t1", "t2", "z1", "z2", "words"]
    zero = [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "z1", "z2", "words")]
    stretch = F.greatest(F.floor((F.col("depth") - 1) / STRETCH), F.lit(0).cast("long"))
    turns = at.where("kind = 1").select(shard, stretch.alias("stretch"), F.lit(1).alias("kind"), *cols[3:])
    heads = at.where("kind = 0").select(shard, F.lit(0).cast("long").alias("stretch"), F.lit(0).alias("kind"), "number", "conv_id", "depth", *zero)
    # conversations beyond one stretch: the border tells the stretch before that
    # they go on, and the stretch behind the name of the prefix
    behind = at.where(f"kind = 1 AND depth > 1 AND depth % {STRETCH} = 1")
    border = behind.select(shard, (stretch - 1).alias("stretch"), F.lit(2).alias("kind"), "number", "conv_id", "depth", *zero)
    long_ones = at.where(f"kind = 1 AND depth = {STRETCH + 1}").select("conv_id")
    whole = at.where("kind = 1").join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "number", stretch.alias("stretch")) \
        .agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.count("*").alias("n"))
    names = running(whole, "conv_id", ["stretch"], xors=("z1", "z2"), name="prefix-names").where(f"n = {STRETCH}")
    names = names.join(behind.select("conv_id", (stretch - 1).alias("stretch")), ["conv_id", "stretch"], "left_semi")
    starts = names.select(shard, (F.col("stretch") + 1).alias("stretch"), F.lit(0).alias("kind"), "number", "conv_id", F.lit(0).cast("long").alias("depth"),
                          *zero[:2], F.col("run_z1").alias("z1"), F.col("run_z2").alias("z2"), zero[4])
    parts = turns.unionByName(heads).unionByName(border).unionByName(starts)
    return parts.groupBy("shard", "stretch").applyInPandas(
        _walk, "p1 long, p2 long, depth long, q1 long, q2 long, n long, conv_id long, words long, ends string, shard long")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sha256 per node over its shards' lists in order, as a stream."""
    now, state = None, None
    for b in batches:
        out: list[tuple] = []
        for p1, p2, ends in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (p1, p2) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (p1, p2), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield _hashes(out)
    if now is not None:
        yield _hashes([(*now, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    p1, p2, h = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(h, pa.string())], names=["p1", "p2", "ends_sha256"])


def _chain_sums(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of each chain with all chains below it, from
    (conv_id, up, leaves, saved): pointer doubling, the jumps of a round twice
    as long as those of the round before."""
    now = staged(chains, "chains")
    while not now.where("up IS NOT NULL").isEmpty():
        given = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        over = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        now = staged(now.join(given, "conv_id", "left").join(over, "up", "left").select(
            "conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chains")
    return now.select("conv_id", "leaves", "saved")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  ``turns`` comes from
    ``turn_rows``."""
    local = staged(shard_nodes(numbered(turns, ids)), "shard-nodes")
    nodes = local.groupBy("p1", "p2").agg(F.min("depth").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
                                          F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"))
    ends = local.where("ends IS NOT NULL").select("p1", "p2", "ends", "shard").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "shard") \
        .select("p1", "p2", "ends").mapInArrow(_hash_ends, "p1 long, p2 long, ends_sha256 string")
    nodes = staged(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(children, ["p1", "p2"], "left").join(ends, ["p1", "p2"], "left").join(above, ["q1", "q2", "depth"], "left")
    full = staged(full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                              F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
                              F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
                              ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie")
    chains = full.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("depth"),
                                         F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = staged(chains, "chain-tops")
    hung = _chain_sums(chains.select("conv_id", "up", "leaves", "saved")) \
        .join(chains.where("up IS NOT NULL").select("conv_id", "up", "depth"), "conv_id") \
        .groupBy(F.col("up").alias("conv_id"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    weighed = full.join(hung, ["conv_id", "depth"], "left").select(
        *full.drop("leaves", "saved").columns, (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (-F.col("depth")).alias("rise"))
    return running(weighed, "conv_id", ["rise"], sums=("leaves", "saved"), name="subtrees").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("run_leaves").alias("n_leaves"),
        F.col("run_saved").alias("saved_tokens"), "ends_sha256")
