"""Periodic runs of words, by recompression (operator 12).

A run is a stretch of consecutive words whose smallest period is q (words q apart
are identical), of length at least max(6, 4 q), that no neighbouring word extends
keeping the period.

The words of a batch of texts, a separator of its own behind each text, are
compressed level by level: maximal blocks of one symbol become one symbol (block
compression, run lengths kept), then every symbol of a left half of the alphabet
followed by one of the right half becomes one symbol with it (pair compression).
Equal stretches get equal symbols but for a symbol at either end, so that the
longest common extension of two places is found by climbing while both stand at
the same border and descending where they part: one step a level (``Grammar``).

Candidates come from harmonic grids: of a run of period q the places g, g + q and
g + 2 q of the grid {0, q, 2 q, ...} hold one word, as do the places behind them.
Grids for all q take n log n comparisons.  Extensions to the right by 2 q or more
and then to the left give the exact run.  Periods go by doubling ranges; a
candidate inside a known run of a smaller period has no run of its own (periods
of overlapping runs divide each other), so every run is found with its smallest
period.

Scale: a map over texts, nothing is shuffled.  A task holds the words of one
slice of texts (1 MB, or one longer text) and its grammar, a few times as many
numbers as words.

Defined cases: null, empty and blank texts have no words and no runs, and collapse
to the empty text; a null id is kept; rows that repeat are each searched; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import plain, ranges, sub_batches, text_bytes

SLICE_BYTES = 1 << 20
#: bytes of a word: all but the space and those from the tab to the carriage return
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


class Grammar:
    """Run-length grammar of a sequence of symbols 0, 1, ... (separators among
    them occur once) with exact longest common extensions in both directions."""

    def __init__(self, seq: np.ndarray):
        self.sym, self.bound, self.up, self.pair = [], [], [], []
        names, level = int(seq.max()) + 1 if len(seq) else 0, seq.astype(np.int32)  # a text holds less than 2**30 words
        while len(level) > 1:
            new = np.ones(len(level), bool)
            new[1:] = level[1:] != level[:-1]
            if not new.all():
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(level)))
                up, many = level[begin], np.flatnonzero(size > 1)
                up[many], names = _name(up[many], size[many], names)
                self._add(level, begin, False)
                level = up
                continue
            first = self._pairs(level)
            begin = np.flatnonzero(np.concatenate([[True], ~first]))
            up = level[begin]
            joined = np.flatnonzero(np.append(first, False)[begin])
            at = begin[joined]
            up[joined], names = _name(level[at], level[at + 1], names)
            self._add(level, begin, True)
            level = up
        self.sym.append(np.append(level, np.int32(-1)))

    @staticmethod
    def _pairs(level: np.ndarray) -> np.ndarray:
        """Places whose symbol is on the left side and the next one on the right;
        of several ways to deal the alphabet the one with most pairs."""
        best, k = None, 0
        while best is None or k < 3 or not best.any():
            side = (level.astype(np.uint64) + np.uint64(1 + 7 * k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(60) & np.uint64(1)
            first = (side[:-1] == 0) & (side[1:] == 1)
            if best is None or np.count_nonzero(first) > np.count_nonzero(best):
                best = first
            k += 1
        return best

    def _add(self, level: np.ndarray, begin: np.ndarray, pair: bool) -> None:
        m = len(level)
        mark = np.zeros(m + 1, np.int32)
        mark[begin] = 1
        mark[m] = 1
        self.sym.append(np.append(level, np.int32(-1)))  # the end, also met as the place before the first
        self.bound.append(np.append(begin, [m, m]).astype(np.int32))
        self.up.append(np.cumsum(mark, dtype=np.int32) - np.int32(1))
        self.pair.append(pair)

    def _step(self, k: int, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How far two places with one symbol go on level k at once: one symbol, or the rest of the shorter block."""
        if self.pair[k]:
            return np.ones(len(i), np.int64)
        up, bound = self.up[k], self.bound[k]
        if back:
            return np.minimum(*(p - bound[up[p] - (bound[up[p]] == p)] for p in (i, j)))
        return np.minimum(*(bound[up[p] + 1] - p for p in (i, j)))

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of equal symbols from places i and j on, or (``back``) before them; i and j differ."""
        sign, off = (-1, -1) if back else (1, 0)
        at_i, at_j, stop = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        live, k = np.arange(len(i)), 0
        while len(live):  # up: while both sides stand at borders of the next level
            a, b, sym = at_i[live], at_j[live], self.sym[k]
            same = sym[a + off] == sym[b + off]
            stop[live] = k
            live, a, b = live[same], a[same], b[same]
            if not len(live):
                break
            up, bound = self.up[k], self.bound[k]
            go = np.flatnonzero((bound[up[a]] != a) | (bound[up[b]] != b))
            step = self._step(k, a[go], b[go], back)
            a[go] += sign * step
            b[go] += sign * step
            level = (bound[up[a]] == a) & (bound[up[b]] == b)
            at_i[live], at_j[live] = np.where(level, up[a], a), np.where(level, up[b], b)
            live, k = live[level], k + 1
        for k in range(int(stop.max()) - 1 if len(stop) else -1, -1, -1):  # down: the rest below the border where they part
            live = np.flatnonzero(stop > k)
            a, b, sym = self.bound[k][at_i[live]], self.bound[k][at_j[live]], self.sym[k]
            go = np.flatnonzero(sym[a + off] == sym[b + off])
            step = self._step(k, a[go], b[go], back)
            a[go] += sign * step
            b[go] += sign * step
            at_i[live], at_j[live] = a, b
        return np.abs(at_i - i)


def _name(a: np.ndarray, b: np.ndarray, names: int) -> tuple[np.ndarray, int]:
    """One new symbol per distinct (a, b), and the number of symbols after that."""
    distinct, at = np.unique(a.astype(np.int64) * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)
    return (names + at).astype(np.int32), names + len(distinct)


def runs_of(seq: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs in ``seq``: texts of ``lens``
    symbols, longest first, a separator of its own behind each."""
    found: list[np.ndarray] = []
    ends = np.cumsum(lens + 1)
    top = int(lens[0]) if len(lens) else 0
    if top < 6:
        return np.zeros((0, 3), np.int64)
    seq = seq.astype(np.int64)
    padded, grammar, cover = np.append(seq, [-2, -3]), None, np.zeros(len(seq) + 1, np.int64)
    low = 1
    while 4 * low <= top:
        grids = []
        for q in range(low, min(2 * low, top // 4 + 1)):
            texts = int(np.searchsorted(-lens, -max(6, 4 * q), side="right"))
            at = seq[:ends[texts - 1]:q] if texts else seq[:0]
            same = at[1:] == at[:-1]
            g = np.flatnonzero(same[1:] & same[:-1]) * q
            if q > 1 and len(g):
                g = g[(padded[g + 1] == padded[g + 1 + q]) & (padded[g + 1] == padded[g + 1 + 2 * q])]
            g = g[cover[g] <= g + 2 * q] if len(g) else g
            if len(g):
                grids.append(np.stack([g, np.full(len(g), q)]))
        low *= 2
        if not grids:
            continue
        grammar = grammar or Grammar(seq)
        g, q = np.concatenate(grids, axis=1)
        right = grammar.extension(g, g + q)
        g, q, end = g[right >= 2 * q], q[right >= 2 * q], (g + q + right)[right >= 2 * q]
        _, one = np.unique(np.stack([end, q]), axis=1, return_index=True)
        g, q, end = g[one], q[one], end[one]
        start = g - grammar.extension(g, g + q, back=True)
        good = end - start >= np.maximum(6, 4 * q)
        found.append(np.stack([start[good], (end - start)[good], q[good]], axis=1))
        for s, e in zip(start[good].tolist(), end[good].tolist()):
            np.maximum(cover[s:e], e, out=cover[s:e])
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a row as bytes, their number per text)."""
    cut = np.frombuffer(texts.buffers()[1], np.int32, count=texts.offset + len(texts) + 1)[texts.offset:].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cut[0]:cut[-1]]
    cut = cut - cut[0]
    inside = IN_WORD[raw]
    text_start = np.zeros(len(raw) + 1, bool)
    text_start[cut] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | text_start[1:-1]
    at = np.flatnonzero(begin)
    data = raw[inside]
    place = np.cumsum(inside, dtype=np.int32)  # bytes of words up to each byte
    offsets = np.append(place[at] - 1, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    return words, np.diff(np.searchsorted(at, cut))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in sub_batches(whole, "text", SLICE_BYTES):
            words, n = _words(b.column("text"))
            first = np.cumsum(n) - n
            order = np.argsort(-n, kind="stable")
            code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(n[order] + 1) - (n[order] + 1)
            seq = np.empty(len(code) + len(n), np.int64)
            seq[begin + n[order]] = len(code) + np.arange(len(n))  # separators
            seq[ranges(begin, n[order])] = code[ranges(first[order], n[order])]
            runs = runs_of(seq, n[order])
            text = np.searchsorted(begin, runs[:, 0], side="right") - 1
            start, length, period, text = runs[:, 0] - begin[text], runs[:, 1], runs[:, 2], order[text]
            by = np.lexsort([period, start, text])
            start, length, period, text = start[by], length[by], period[by], text[by]
            # a word inside a run, but for the first period, is dropped
            edge = np.zeros(len(code) + 1, np.int64)
            np.add.at(edge, first[text] + start + period, 1)
            np.add.at(edge, first[text] + start + length, -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])
            lists = pa.ListArray.from_arrays(pa.array(kept[np.append(first, len(code))], pa.int32()), words.filter(pa.array(keep)))
            at = np.searchsorted(text, np.arange(len(n) + 1))
            fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), fields),
                                              pc.binary_join(lists, b" ").cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text by start and
    period, and its words, one space between them, without those that a run
    contains after its first period."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(plain(id_col)[0].alias("doc_id"), text_bytes(f"`{text_col}`").alias("text")) \
        .mapInArrow(_search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
