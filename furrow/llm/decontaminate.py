"""Benchmark decontamination with sharded suffix arrays (operator 5).

Each batch of documents is a shard.  Its words become integers (benchmark
words only; any other word is 0 and never matches) and its suffixes are sorted
by their first ``DEPTH`` words: a suffix array.  Only suffixes that open with
the first words of some benchmark window enter it, as no other can match.
Every benchmark suffix is then binary-searched in the array, which gives all
places where its window occurs; adjacent hits on one diagonal are joined into
maximal verbatim matches with their locations.

Scale.  Documents are never shuffled: shards are independent and the work is
linear in the text.  The benchmark is dealt into blocks of ``BLOCK_BYTES``
(sizes are counted first) that Spark writes to the shared folder; each block is
one pass over the documents, whose tasks read it from there.  The driver holds
no part of the benchmark, a worker one block at a time, however large the
benchmark is.  Only documents with a match enter the merge of the passes.

Defined cases: a null text has no words; an item of 1 to 9 words is one window
as a whole; an item without words never occurs; items without an id are left
out; rows that share an item_id are one item, repeats of one (id, text) count
once; repeated document rows are rows of their own; empty tables give no match; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD_TABLE, plain, rows_with_id, staged, sub_batches, text_bytes
from furrow.session import scratch_path

WINDOW = 10
DEPTH = 16
BLOCK_BYTES = 16 << 20

_FOUND = "uid long, item string, item_pos int, doc_pos int, n_words int"


class Suffixes:
    """A block of benchmark items, ready to be searched in shards."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        if not 1 <= window <= DEPTH:
            raise ValueError(f"window must be 1 to {DEPTH}")
        self.vocab: dict[bytes, int] = {}
        self.ids: list[str] = []
        words, starts, lens, owner, base = [], [], [], [], 0
        for item, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in text.translate(WORD_TABLE).split()]
            if not w:
                continue
            n = max(len(w) - window + 1, 1)
            starts.append(base + np.arange(n))
            lens.append(np.full(n, min(window, len(w))))
            owner.append(np.full(n, len(self.ids)))
            self.ids.append(item)
            words.append(np.array(w + [0] * DEPTH, dtype=np.int64))
            base += len(w) + DEPTH
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.words, self.start, self.len, self.owner = cat(words), cat(starts), cat(lens), cat(owner)
        first = self.owner.searchsorted(np.arange(len(self.ids)))
        self.pos = self.start - self.start[first][self.owner] if len(self.ids) else self.start
        self.bits = max(len(self.vocab).bit_length(), 1)
        two = self.len > 1
        self.opening = np.unique(self._pair(self.words, self.start[two]))
        self.single = np.zeros(len(self.vocab) + 1, bool)
        self.single[self.words[self.start[~two]]] = True
        self.firsts = self.single.copy()
        self.firsts[self.words[self.start]] = True

    def _pair(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (words[at] << 32) | words[at + 1]

    def keys(self, words: np.ndarray, at: np.ndarray, n: np.ndarray | None = None, fill: int = 0) -> list[np.ndarray]:
        """The first DEPTH words from each place, packed into integers that sort
        alike; words from the n-th on are replaced by ``fill``."""
        per = 62 // self.bits
        out = []
        for lo in range(0, DEPTH, per):
            key = np.zeros(len(at), np.int64)
            for j in range(lo, min(lo + per, DEPTH)):
                w = words[at + j]
                key = (key << self.bits) | (w if n is None else np.where(j < n, w, fill))
            out.append(key)
        return out

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence.  ``words`` ends in DEPTH zeros."""
        at = np.flatnonzero(self.firsts[words[:-DEPTH]])
        pair, hit = self._pair(words, at), self.single[words[at]]
        if len(self.opening):
            k = np.minimum(self.opening.searchsorted(pair), len(self.opening) - 1)
            hit |= self.opening[k] == pair
        at = at[hit]
        keys = self.keys(words, at)
        order = np.lexsort(keys[::-1])
        array, keys = at[order], [k[order] for k in keys]  # the shard's suffix array
        lo = _bound(keys, self.keys(self.words, self.start, self.len, 0), False)
        hi = _bound(keys, self.keys(self.words, self.start, self.len, (1 << self.bits) - 1), True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return which, array[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)]


def _bound(keys: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
    """Vectorised binary search of compound keys in a sorted array of them."""
    lo, hi = np.zeros(len(query[0]), np.int64), np.full(len(query[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        m = np.minimum(mid, max(len(keys[0]) - 1, 0))
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, q in zip(keys, query):
            less |= same & (k[m] < q)
            same &= k[m] == q
        go = open_ & (less | same if right else less)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def _scan(s: Suffixes, texts: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Words per text of a shard, and the maximal matches: text, item, item_pos, doc_pos, n_words."""
    get, parts, sizes = s.vocab.get, [], []
    for t in texts:
        w = t.translate(WORD_TABLE).split()
        parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), np.zeros(1, np.int32)]
        sizes.append(len(w))
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    words = np.concatenate([*parts, np.zeros(DEPTH, np.int32)]).astype(np.int64)
    which, at = s.search(words)
    item, pos, n = s.owner[which], s.pos[which], s.len[which]
    order = np.lexsort((at, at - pos, item))
    item, pos, at, n = item[order], pos[order], at[order], n[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(at - pos) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[:len(first)] - 1
    doc = np.searchsorted(starts, at[first], side="right") - 1
    return np.array(sizes, np.int64), {"text": doc, "item": item[first], "item_pos": pos[first], "doc_pos": at[first] - starts[doc],
                                       "n_words": at[last] - at[first] + n[last]}


_LOADED: dict[tuple, Suffixes] = {}


def _load(folder: str, k: int, window: int) -> Suffixes:
    """Block ``k`` of the benchmark from the shared folder; a worker keeps the
    last one it read, for the tasks that follow."""
    key = (folder, k, window)
    if key not in _LOADED:
        from pyarrow import dataset, fs

        _LOADED.clear()
        where, path = fs.FileSystem.from_uri(f"{folder}/block={k}")
        rows = []
        if where.get_file_info(path).type != fs.FileType.NotFound:  # a block that no item fell into has no folder
            t = dataset.dataset(path, filesystem=where, format="parquet").to_table(columns=["item", "text"])
            rows = sorted(zip(t["item"].to_pylist(), t["text"].to_pylist()))
        _LOADED[key] = Suffixes(rows, window)
    return _LOADED[key]


def _matches(block: tuple[str, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _load(*block)
        for whole in batches:
            for b in sub_batches(whole, "text"):
                _, f = _scan(s, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    b.column("uid").take(pa.array(f["text"])), pa.array([s.ids[i] for i in f["item"]], pa.string()),
                    *(pa.array(f[c], pa.int32()) for c in ("item_pos", "doc_pos", "n_words"))],
                    names=["uid", "item", "item_pos", "doc_pos", "n_words"])
    return run


def _one_pass(block: tuple[str, int, int]):
    """A row per document: its words, the items that occur and the spans of the matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _load(*block)
        for whole in batches:
            for b in sub_batches(whole, "text"):
                sizes, f = _scan(s, b.column("text").to_pylist())
                items: dict[int, set] = defaultdict(set)
                spans: dict[int, set] = defaultdict(set)
                for d, i, p, n in zip(*(f[c].tolist() for c in ("text", "item", "doc_pos", "n_words"))):
                    items[d].add(s.ids[i])
                    spans[d].add((p, n))
                docs = range(b.num_rows)
                yield pa.RecordBatch.from_arrays([
                    b.column("uid"), b.column("doc_id"), pa.array(sizes),
                    pa.array([sorted(items.get(d, ())) for d in docs], pa.list_(pa.string())),
                    pa.array([[{"p": p, "n": n} for p, n in sorted(spans.get(d, ()))] for d in docs], pa.list_(_SPAN))],
                    names=["uid", "doc_id", "n_words", "items", "spans"])
    return run


_SPAN = pa.struct([("p", pa.int32()), ("n", pa.int32())])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[tuple[str, int, int]]:
    """The benchmark written as blocks of bounded size, (folder, number, window)
    each; their number follows a count of its bytes.  Rows that repeat are one."""
    if not 1 <= window <= DEPTH:
        raise ValueError(f"window must be 1 to {DEPTH}")
    items = benchmark.select(plain(id_col)[0].cast("string").alias("item"), text_bytes(f"`{text_col}`").alias("text")).where("item IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes))
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")).repartition("block").write.partitionBy("block").parquet(folder)
    return [(folder, k, window) for k in range(n)]


def _source(docs: DataFrame, text_col: str, blocks: list, *cols) -> DataFrame:
    """Texts with a row number; written once if several passes must agree on it."""
    src = docs.select(*cols, text_bytes(f"`{text_col}`").alias("text"))
    if "uid" not in src.columns:
        src = src.withColumn("uid", F.monotonically_increasing_id())
    return staged(src, "documents") if len(blocks) > 1 else src


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, item, item_pos, doc_pos, n_words): every maximal verbatim match of
    at least ``window`` words.  ``docs`` brings a ``uid`` per row."""
    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    src = _source(docs, text_col, blocks, "uid").select("uid", "text")
    return reduce(DataFrame.unionByName, [src.mapInArrow(_matches(b), _FOUND) for b in blocks])


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside a window's
    occurrence), n_items, items (sorted ids), longest (words of the longest
    match), contaminated."""
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    src = _source(docs, text_col, blocks, plain(id_col)[0].alias("doc_id")).select("uid", "doc_id", "text")
    schema = f"uid long, doc_id {kind}, n_words long, items array<string>, spans array<struct<p:int,n:int>>"
    out = reduce(DataFrame.unionByName, [src.mapInArrow(_one_pass(b), schema) for b in blocks])
    if len(blocks) > 1:
        out = out.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                     F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    n_hit = F.expr("""aggregate(array_sort(spans), named_struct('to', 0, 'n', 0L),
        (a, s) -> named_struct('to', greatest(a.to, s.p + s.n), 'n', a.n + greatest(0, s.p + s.n - greatest(a.to, s.p))), a -> a.n)""")
    items = F.array_sort(F.array_distinct("items"))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      F.coalesce(F.array_max(F.transform("spans", lambda s: s["n"])), F.lit(0)).alias("longest"),
                      (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window."""
    id_col = kw.get("id_col", "doc_id")
    return rows_with_id(docs, contamination(docs, benchmark, **kw).where("contaminated").select("doc_id"), id_col, keep=False)
