"""Token ids in frequency-ranked, byte-aligned variable-length files (operator 1).

Every text is encoded with a tokenizer file, the end id is appended, and the
ids are replaced by their rank in the corpus (0: the most frequent; ties by
id).  A rank takes 1 to 4 little-endian data bytes; its length minus one is a
2-bit code, four codes to a control byte.  Control bytes and data bytes are
kept apart, so that a reader finds all lengths by a 256-row table lookup and
all values by vectorised gathers.

File (``*.fvb``, little-endian): magic ``FVB1``; then blocks of
u32 documents, u64 control bytes, u64 data bytes, the doc ids (i64), a null
flag each (u8), the token counts (u64), control bytes, data bytes.  A
document's codes start on a control byte of their own.  Files are in ascending
doc_id order (nulls first), as are the documents in a file; a manifest table
lists (shard, path, documents, tokens).  The rank table is a Parquet table.

Scale.  Texts are read and encoded once; what is shuffled are coded ids.  Rank
counts are one vector per task, summed by id.  The rank table is bounded by the
vocabulary, the only thing that is broadcast.  Shards are range partitions, so
their number follows the data.  A retried task writes under a new name and the
manifest, committed by Spark, lists only the shards that count.

Words between single spaces are encoded once per worker, by stem, and looked up
after that (``CACHE_WORDS`` stems and other units bound the memory): in byte-level BPE with the usual
splitting pattern a space between two non-spaces always opens a new unit, so
the ids of a text are those of its words in a row.  Any other tokenizer file
gets whole texts.

Defined cases: null and empty texts hold the end id only; rows that repeat are
encoded each; a null doc_id sorts first; an empty table gives no files and no
rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import plain, ranges, staged, sub_batches
from furrow.session import scratch_path

CACHE_WORDS = 400_000
LEARN_WORDS = 10_000
BLOCK_TOKENS = 1 << 20
MAGIC = b"FVB1"
_HEAD = "<IQQ"

#: per control byte: lengths of its four values
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as itself where it is a visible character,
    else as the next free character from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: letters, one mark, a line end, letters, one mark: each a unit of the splitting pattern
_SIMPLE = rf"^(?P<a>{_LETTERS})(?P<b>[.,;:!?]?)(?:(?P<c>\n)(?P<d>{_LETTERS})(?P<e>[.,;:!?]?))?$"
#: white space, which no word that is kept opens with
_BARE = "\n"
#: words that are given to the library as one text
JOIN_WORDS = 300
_GAP = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of whole texts by the tokenizers library, with a bounded cache of
    units: a stem with the space before it serves all words made of it, a mark
    and a line end.  Units that were not met for longest leave the cache.  A
    unit without a space before it is kept under its name behind ``_BARE``."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        self.tok = Tokenizer.from_str(raw)
        self.tok.encode_special_tokens = special_as_text
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_word = (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("ignore_merges")
                        and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens") or ()))
        self.model = self.tok.model
        self.index: dict[str, int] = {}
        self.flat, self.start, self.len, self.met = np.zeros(1 << 16, np.int32), *(np.zeros(1 << 14, np.int64) for _ in range(3))
        self.units = self.used = self.clock = 0
        if self.by_word:
            self._spaces()

    def _spaces(self) -> None:
        """Which ids open with a space; stems in a row can be encoded at once if
        no entry of the vocabulary of letters and spaces has one behind a letter."""
        space, vocab = _BYTE_LETTERS[32], self.tok.get_vocab()
        letters = set("".join(map(chr, [*range(65, 91), *range(97, 123)])) + "".join(_BYTE_LETTERS[b] for b in (195, *range(128, 192))))
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for v, i in vocab.items() if v.startswith(space)]] = True
        self.in_a_row = not any(space in v.lstrip(space) and letters.issuperset(v.replace(space, "")) for v in vocab)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 20_000):
            out += [e.ids for e in self.tok.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False)]
        return out

    def _unit(self, unit: str) -> list[int]:
        """Ids of one unit of the splitting pattern: the model alone, no splitting."""
        return [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(_BYTE_LETTERS))]

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number per stem) of stems with a space before each."""
        if not self.in_a_row:
            return _rows([self._unit(" " + u) for u in stems])
        ids = np.array([i for k in range(0, len(stems), 64) for i in self._unit(" " + " ".join(stems[k:k + 64]))], np.int32)
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))

    def _bare(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number per unit) of units kept without a space before them."""
        return _rows([self._unit(u.removeprefix(_BARE)) for u in units])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number per word) of words with a space before
        each: many make one text, whose ids are cut where one opens with a
        space.  If that finds other than one cut per word, each is a text."""
        ids, _ = _rows(self._whole([" " + " ".join(words[k:k + JOIN_WORDS]) for k in range(0, len(words), JOIN_WORDS)]))
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(words) or len(cuts) and cuts[0]:
            return _rows(self._whole([" " + w for w in words]))
        return ids, np.diff(np.append(cuts, len(ids)))

    def _find(self, units: list[str], learn) -> np.ndarray:
        """Places of distinct units in the cache; ``learn`` encodes new ones, in
        slices, so that its lists of Python numbers stay small."""
        at = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0).tolist()
        for k in range(0, len(missing), LEARN_WORDS):
            new = [units[i] for i in missing[k:k + LEARN_WORDS]]
            ids, lens = learn(new)
            base, top = self.units, self.units + len(new)
            self.flat = _room(self.flat, self.used + len(ids))
            self.start, self.len, self.met = (_room(x, top) for x in (self.start, self.len, self.met))
            self.flat[self.used:self.used + len(ids)] = ids
            self.start[base:top], self.len[base:top] = self.used + np.cumsum(lens) - lens, lens
            self.index.update(zip(new, range(base, top)))
            at[missing[k:k + LEARN_WORDS]] = np.arange(base, top)
            self.units, self.used = top, self.used + len(ids)
        self.met[at] = self.clock
        return at

    def _trim(self) -> None:
        """Keep the two thirds that were met last."""
        keep = np.sort(np.argsort(-self.met[:self.units], kind="stable")[:CACHE_WORDS * 2 // 3])
        names, lens = list(self.index), self.len[keep]
        self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.flat = self.flat[ranges(self.start[keep], lens)]
        self.start, self.len, self.met = np.cumsum(lens) - lens, lens, self.met[keep]
        self.units, self.used = len(keep), len(self.flat)

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of up to five units per word, -1: none; whether its texts must
        be cut with more care).  A word's space before it is implied; an empty
        word or one with white space at an end is of the second kind."""
        match = pc.extract_regex(distinct, _SIMPLE)
        simple = match.is_valid().to_numpy(zero_copy_only=False)
        at, odd = np.full((len(distinct), 5), -1, np.int64), np.zeros(len(distinct), bool)
        match = match.filter(pa.array(simple))
        for k, field in enumerate("abcde"):
            coded = pc.fill_null(match.field(field), "").dictionary_encode()
            units = _strings(coded.dictionary)
            found = self._find(units, self._stems) if k == 0 else np.full(len(units), -1, np.int64)
            if k and (some := [i for i, u in enumerate(units) if u]):
                found[some] = self._find([_BARE + units[i] for i in some], self._bare)
            at[simple, k] = found[coded.indices.to_numpy()]
        rest = np.flatnonzero(~simple)
        words = _strings(distinct.take(pa.array(rest)))
        odd[rest] = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        whole = np.flatnonzero(~odd[rest])
        at[rest[whole], 0] = self._find([words[i] for i in whole.tolist()], self._words)
        return at, odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, their number per text)."""
        if not self.by_word:
            return _rows(self._whole(texts.to_pylist()))
        self.clock += 1
        if self.units > CACHE_WORDS:
            self._trim()
        words = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = np.append(0, ends[:-1])[:len(ends)]
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        at, odd = self._pieces(coded.dictionary)
        # the ids of every distinct word, from those of its units
        here = at >= 0
        units = at[here]
        size = np.zeros(at.shape, np.int64)
        size[here] = self.len[units]
        flat = self.flat[ranges(self.start[units], self.len[units])]
        odd = np.flatnonzero(odd)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(code, odd)), side="right")) if len(odd) else odd
        # a text's first word has no space before it; the texts marked odd are
        # encoded on their own: both stand behind the ids of words, then an empty list
        extra = self._whole(coded.dictionary.take(pa.array(code[begin])).to_pylist())
        pick = code.copy()
        pick[begin] = len(at) + np.arange(len(texts))
        for i in odd.tolist():
            extra[i] = self._careful(texts[i].as_py())
            pick[begin[i] + 1:ends[i]] = len(at) + len(texts)
        more, lens = _rows(extra)
        cuts = np.cumsum(np.concatenate([[0], size.sum(axis=1), lens, [0]]))
        out = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(np.concatenate([flat, more]))).take(pa.array(pick))
        total = np.concatenate([[0], np.cumsum(pc.list_value_length(out).to_numpy().astype(np.int64))])
        return out.flatten().to_numpy(), total[ends] - total[begin]

    def _careful(self, text: str) -> list[int]:
        """Cut only at a single space between two non-spaces."""
        if not text:
            return []
        parts = _GAP.split(text)
        return [i for ids in self._whole([parts[0], *(" " + p for p in parts[1:])]) for i in ids]


def _strings(column: pa.Array) -> list[str]:
    """``to_pylist`` of strings without nulls, converted as a whole."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers in a row, their number per list)."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum())), lens


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` itself, or with room for ``n`` entries and half as many more."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(n + n // 2 - len(x), x.dtype)])


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, special_as_text: bool) -> Encoder:
    """One per Python worker: its cache serves all tasks that the worker runs."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]


def _encode(path: str, eos: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, special_as_text)
        for whole in batches:
            for b in sub_batches(whole, "text", 6 << 20):
                ids, lens = enc.encode(b.column("text"))
                ends = np.cumsum(lens)
                ids = np.insert(ids, ends, eos)
                small = ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids.astype("<u4")
                cut = np.concatenate([[0], ends + np.arange(1, len(lens) + 1)]) * small.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(small.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lens + 1), data.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])
    return run


def encode(docs: DataFrame, tokenizer_path: str, eos_id: int = 2, text_col: str = "text", id_col: str = "doc_id",
           special_as_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): little-endian unsigned ids, 16 bits each if a
    batch needs no more, else 32."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(plain(id_col)[0].alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")) \
        .mapInArrow(_encode(tokenizer_path, eos_id, special_as_text), f"doc_id {kind}, n_tokens long, ids binary")


def _values(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.zeros(0, "<u2")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for whole in batches:
        for b in sub_batches(whole, "ids", 2 * BLOCK_TOKENS):
            c = np.bincount(np.concatenate([_values(x.as_buffer(), n) for x, n in zip(b.column("ids"), b.column("n_tokens").to_pylist())]))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[:len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def rank_table(encoded: DataFrame) -> DataFrame:
    """(id, n): corpus counts; the rank is the place by n descending, id ascending."""
    return encoded.select("n_tokens", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_slots(counts: np.ndarray) -> np.ndarray:
    """Where the codes of documents stand: each starts on a control byte."""
    four = -(-counts // 4) * 4
    return ranges(np.cumsum(four) - four, counts)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values, ``counts`` of them per document."""
    v = np.ascontiguousarray(ranks, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(int((-(-counts // 4)).sum()) * 4, np.uint8)
    four[code_slots(counts)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(code.max()) + 1 if len(code) else 1
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) <= code[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Values by table lookup; ``keep`` marks the codes that are values, not padding."""
    lens = LENGTHS[control].ravel()[keep]
    at = np.cumsum(lens) - lens
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shard(folder: str, rank_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, shard = rank_of.value, TaskContext.get().partitionId()
        out, docs, tokens, name = None, 0, 0, f"{shard:08d}-{uuid.uuid4().hex}.fvb"
        try:
            for whole in batches:
                for b in sub_batches(whole, "ids", 2 * BLOCK_TOKENS):
                    if out is None:
                        fs, path = _filesystem(folder)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(MAGIC)
                    ids, n = b.column("doc_id").cast(pa.int64()), b.column("n_tokens").to_numpy()
                    control, data = pack(np.concatenate([rank[_values(x.as_buffer(), k)] for x, k in zip(b.column("ids"), n.tolist())]), n)
                    out.write(struct.pack(_HEAD, len(n), len(control), len(data)))
                    out.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                    out.write(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                    out.write(n.astype("<u8").tobytes())
                    out.write(control)
                    out.write(data)
                    docs, tokens = docs + len(n), tokens + int(n.sum())
        finally:
            if out is not None:
                out.close()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([docs], pa.int64()),
                                              pa.array([tokens], pa.int64())], names=["shard", "path", "documents", "tokens"])
    return run


def write_ids(encoded: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write ``encoded`` (doc_id, n_tokens, ids) below ``folder``; returns the
    manifest and the rank table, both read back from there."""
    spark = encoded.sparkSession
    rank_table(encoded).write.parquet(f"{folder}/ranks")
    ranks = spark.read.parquet(f"{folder}/ranks")
    order = _order(ranks)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id") \
        .mapInArrow(_write_shard(f"{folder}/shards", spark.sparkContext.broadcast(rank_of)), "shard long, path string, documents long, tokens long") \
        .write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest"), ranks


def _order(ranks: DataFrame) -> np.ndarray:
    """Ids by rank; as many as the vocabulary has at most."""
    pdf = ranks.select("id", "n").toPandas()
    return pdf.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, null flags, token counts, ranks) per block of an open file."""
    if (magic := stream.read(4)) != MAGIC:
        raise ValueError(f"not an FVB1 file: {magic!r}")
    while head := stream.read(struct.calcsize(_HEAD)):
        n, c, d = struct.unpack(_HEAD, head)
        ids, null = np.frombuffer(stream.read(8 * n), "<i8"), np.frombuffer(stream.read(n), np.uint8)
        count = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        control, data = np.frombuffer(stream.read(c), np.uint8), np.frombuffer(stream.read(d), np.uint8)
        keep = np.zeros(4 * c, bool)
        keep[code_slots(count)] = True
        yield ids, null.astype(bool), count, unpack(control, data, keep)


def _read_shards(order, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = order.value.astype("<u4")
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                fs, at = _filesystem(path)
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    for ids, null, count, ranks in read_blocks(f):
                        raw = id_of[ranks].tobytes()
                        ends = np.cumsum(count)
                        cut = [(4 * int(e - n), 4 * int(e)) for n, e in zip(count, ends)]
                        view = memoryview(raw)
                        cols = [pa.array(ids, mask=null), pa.array(start + ends - count), pa.array(count),
                                pa.array([zlib.crc32(view[x:y]) for x, y in cut], pa.int64())]
                        if with_ids:
                            cols.append(pa.array([raw[x:y] for x, y in cut], pa.binary()))
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
                        start += int(ends[-1])
    return run


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and,
    if asked for, the ids (little-endian unsigned 32-bit).  Files are dealt to
    tasks one by one; a task holds one block at a time."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row per shard file, a few million at 100 TB: their sizes are summed in order on the driver
    shards = manifest.select("shard", "path", "tokens").orderBy("shard").collect()
    rows, start = [], 0
    for r in shards:
        rows.append((r.path, start))
        start += r.tokens
    order = spark.sparkContext.broadcast(_order(spark.read.parquet(f"{folder}/ranks")))
    starts = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return starts.mapInArrow(_read_shards(order, with_ids), schema)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **kw) -> str:
    """Encode ``docs`` into files below ``folder`` (a fresh one in the shared
    checkpoint folder if None) and return it."""
    folder = folder or scratch_path(docs.sparkSession, "token-ids")
    write_ids(staged(encode(docs, tokenizer_path, **kw), "encoded"), folder)
    return folder
