"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams
and skip-grams (operator 3).

Features are single words (whole, and as stems of their first ``STEMS`` bytes,
since insults come in many inflected forms), pairs of neighbours and pairs with
one word between (A-Z lower-cased words), hashed to ``2**BITS`` places; a feature that occurs c
times in a text has the value log2(1 + c).  Training is FTRL-proximal: every
coordinate has its own learning rate, and the L1 term keeps most weights at
exactly zero, so the model is a short list of (place, weight).

Scale.  The model is learned from at most ``MAX_TRAIN_ROWS`` labelled rows,
those with the smallest hash of their id, each read up to its end but trained
on only if the row has at most ``MAX_TRAIN_BYTES`` of text: the bounds keep the
one training task small at any corpus size.  The labelled ids (bounded by the
same number) are broadcast, so no text is shuffled.  Scoring covers every row
and every whole text in one narrow pass; the weights that go to the tasks are
bounded by ``2**BITS`` places.

Defined cases: a null or empty text has no features and gets the score of the
bias; without any labelled row the score is 0; labels that are null do not
count; of labels that repeat for an id the largest counts; rows that repeat are
scored each; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD_TABLE, plain, staged, sub_batches, text_bytes

BITS = 20
MAX_TRAIN_ROWS = 8_000
MAX_TRAIN_BYTES = 1 << 20
THRESHOLD = 0.7
STEMS = (4, 5)

#: FTRL-proximal: learning rate, its offset, L1, L2, passes over the rows
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 0.1, 3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Word to its number in a batch: a word is hashed once per batch."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _hashes(words: list[bytes], salt: bytes) -> np.ndarray:
    return np.fromiter((zlib.crc32(salt + w) for w in words), np.uint64, len(words))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature occurrence."""
    number, parts, sizes = _Words(), [], []
    for t in texts:
        w = t.translate(WORD_TABLE).split()
        parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        sizes.append(len(w))
    at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    shift, words = np.uint64(64 - BITS), list(number)
    h = _hashes(words, b"")[at]
    where, place = [doc], [(h * _MIX) >> shift]
    for n in STEMS:
        where.append(doc)
        place.append(((_hashes([w[:n] for w in words], b"%d " % n) * _MIX) >> shift)[at])
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        place.append((((h[:-gap] * _STEP + h[gap:] + np.uint64(gap)) * _MIX) >> shift)[same])
        where.append(doc[gap:][same])
    return np.concatenate(where), np.concatenate(place).astype(np.int64)


def _counted(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, place) in order, with their values."""
    key, n = np.unique((doc << BITS) | place, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.log2(1.0 + n)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over all rows of the (bounded) input, in their order."""
    place, value, size, label = [], [], [], []
    for whole in batches:
        for b in sub_batches(whole, "text", 2 << 20):
            doc, p = _features(b.column("text").to_pylist())
            doc, p, v = _counted(doc, p)
            place.append(p.astype(np.int32))
            value.append(v.astype(np.float16))
            size.append(np.bincount(doc, minlength=b.num_rows))
            label += b.column("toxic").to_pylist()
    if not label:
        return
    size = np.concatenate(size)
    place = np.concatenate(place)
    keep = (np.bincount(place, minlength=1 << BITS) > 2)[place]  # a place of one or two rows teaches nothing
    place = place[keep]
    value = np.concatenate(value)[keep]
    cut = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[np.concatenate([[0], np.cumsum(size)])]
    del keep
    z, n, w = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    for _ in range(EPOCHS):
        for i, y in enumerate(label):
            at = np.append(place[cut[i]:cut[i + 1]], bias)
            x = np.append(value[cut[i]:cut[i + 1]], 1.0)
            zi, ni = z[at], n[at]
            l1 = np.where(at == bias, 0.0, L1)
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1.0 / (1.0 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    l1 = np.full(len(z), L1)
    l1[bias] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], names=["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
          max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(place, weight) of the model; place ``2**BITS`` is the bias.  ``labels``
    holds the rows to learn from, at most ``max_rows`` of which are used."""
    chosen = labels.select(plain(id_col)[0].alias("id"), plain(label_col)[0].cast("int").alias("toxic")) \
        .where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic")) \
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(plain(id_col)[0].alias("id"), text_bytes(f"`{text_col}`").alias("text")) \
        .where(F.length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "id") \
        .groupBy("id", "toxic").agg(F.min("text").alias("text"))  # of rows with one id the smallest text
    rows = staged(rows.select("id", "toxic", "text"), "labelled")
    return staged(rows.coalesce(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "toxic")
                  .mapInArrow(_train, "place int, weight double"), "weights")


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = model.value
        for whole in batches:
            for b in sub_batches(whole, "text", 2 << 20):
                score = np.zeros(b.num_rows)
                if known:
                    doc, place = _features(b.column("text").to_pylist())
                    live = w[place] != 0
                    doc, place, value = _counted(doc[live], place[live])
                    logit = w[1 << BITS] + np.bincount(doc, w[place] * value, minlength=b.num_rows)
                    score = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
                rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*(n for n in b.schema.names if n != "text"), "score"])
    return run


def score(docs: DataFrame, weights: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    w = np.zeros((1 << BITS) + 1)
    model = weights.toPandas()  # bounded by 2**BITS places
    w[model["place"].to_numpy(np.int64)] = model["weight"].to_numpy()
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast((w, len(model) > 0))
    return docs.select(plain(id_col)[0].alias("doc_id"), text_bytes(f"`{text_col}`").alias("text")) \
        .mapInArrow(_score(model), f"doc_id {kind}, score double")


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels to learn from: crc32 of the id as text, mod 3, is not 1."""
    return labels.where(F.crc32(plain(id_col)[0].cast("string").cast("binary")) % 3 != 1)


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD,
             max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; a null id is
    never learned from and counts as held out."""
    weights = train(docs, training_rows(labels, id_col), text_col, id_col, max_rows=max_rows)
    return score(docs, weights, text_col, id_col).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
