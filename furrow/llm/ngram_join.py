"""N-gram Jaccard join with prefix trees (operator 7).

A document's set is its distinct word n-grams (A-Z lower-cased words between
white space; a text of fewer words is one n-gram as a whole), each hashed to 64
bits.  Two documents link if 100 * |x and y| >= threshold * |x or y|.  The join
is exact on these sets.

1. Sets.  Equal sets become one class (by a 128-bit digest); all further work is
   on one representative per class.
2. Candidates, without loss.  Of each set the smallest hashes are kept, a share
   of 1 - t plus ``1 / EXTRA``: two sets that link then share at least
   ceil(n / EXTRA) of them, n being the smaller size.  A set of which fewer are
   held by any other set cannot link and drops out.  The rest is judged again by
   whole sets, of which a link asks for t.  Corpus counts of the n-grams then give
   one global order, rare first, and a set is posted under the shortest prefix in
   that order which must meet every partner's prefix.
3. Blocks.  Posting lists connect candidates to groups; a group that is too large
   for a task is cut into blocks.
4. Prefix trees.  In a block the full sets are written in one order, frequent
   first, and stored in a trie with joined edges.  Each set walks the trie once:
   overlap is counted once per shared prefix, and a subtree is left out if the
   overlap so far plus what remains cannot reach what its sizes ask for, or if
   all its sets are already connected with the walker.
5. Blocks of one group are bridged by representatives of what is connected so
   far, again by trie.  Posting lists that still hold several components are
   then joined in full, block against block, so no link is lost.
6. Components over the links.

Scale.  Texts are read twice and only documents with candidates are read again
by key.  Counting is two-sided: a chunk of documents asks once for each of its
distinct n-grams and gets back those that others hold, so an n-gram held by a
third of all documents is one row per chunk.  Copies never become pairs: a
group of m connected sets gives m - 1 links.  Blocks are bounded in sets and in
n-grams.  All intermediate tables are in the shared checkpoint folder, and those
no longer read are deleted.

Defined cases: null text and text without words: empty set, linked with
nothing; rows that repeat are rows of their own and share a component (the same
doc_id twice is one id); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import components, plain, release, rows_with_id, staged, sub_batches, text_bytes

SHINGLE = 4
THRESHOLD = 85
EXTRA = 12
CHUNK_BITS = 12
BUCKET_GRAMS = 1 << 18
BLOCK_SETS = 2000
BLOCK_GRAMS = 4 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def least_overlap(n, threshold: int):
    """What a set of n elements shares at least with any set it links with."""
    return -(-threshold * n // 100)


def kept(n, threshold: int):
    """How many of its smallest hashes a set keeps, and how many of them it
    shares at least with any set it links with."""
    low = least_overlap(n, threshold)
    return n - low + -(-n // EXTRA), -(-low // EXTRA)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def gram_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams."""
    import xxhash

    number, parts = _Words(), []
    for t in texts:
        w = t.lower().split()  # of bytes: A-Z only, ASCII white space only
        parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    out = []
    for p in parts:
        h = word[p]
        if not len(h):
            out.append(h)
        elif len(h) < size:
            acc = np.full(1, len(h), np.uint64)
            for x in h[:, None]:
                acc = _mixed(acc * _A + x)
            out.append(acc)
        else:
            acc = h[:len(h) - size + 1]
            for k in range(1, size):
                acc = acc * _A + h[k:len(h) - size + 1 + k]
            out.append(np.unique(_mixed(acc)))
    return out


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _digest(grams: np.ndarray) -> str:
    import hashlib

    return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest()


def _sketch(size: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sub_batches(whole, "text", 4 << 20):
                sets = gram_sets(b.column("text").to_pylist(), size)
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column("uid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.string()),
                    _binary([s[:kept(len(s), threshold)[0]] for s in sets])], names=["uid", "doc_id", "n", "digest", "grams"])
    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    for whole in batches:
        for b in sub_batches(whole, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([zlib.compress(t, 1) for t in b.column("text").to_pylist()], pa.binary())], names=["id", "text"])


def _full(size: int):
    """Full sets of the wanted rows; of rows with the same id only the one with the wanted set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sub_batches(whole, "text", 4 << 20):
                sets = gram_sets([zlib.decompress(t) for t in b.column("text").to_pylist()], size)
                good = [i for i, d in enumerate(b.column("digest").to_pylist()) if len(sets[i]) and _digest(sets[i]) == d]
                uid = b.column("uid").take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(uid.to_pylist()[:1] * len(good), pa.int64()), uid, pa.array([len(sets[i]) for i in good], pa.int64()),
                                                  _binary([sets[i] for i in good])], names=["chunk", "uid", "n", "grams"])
    return run


def _column(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]


def _only(rows: pa.Table, reps: pa.Table) -> pa.Table:
    """The representatives of a chunk."""
    return rows.filter(pa.array(np.isin(rows.column("uid").to_numpy(), reps.column("uid").to_numpy())))


def _ask(buckets: int):
    """Each distinct n-gram of a chunk and how many of its sets hold it, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
            for lo, hi in zip(cuts, cuts[1:]):
                grams = np.frombuffer(b"".join(b.column("grams").slice(lo, hi - lo).to_pylist()), np.uint64)
                gram, count = np.unique(grams, return_counts=True)
                home = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending, as the grams are
                cut = np.searchsorted(home, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int64()), pa.array([int(chunks[lo])] * len(full), pa.int64()), _binary([gram[cut[k]:cut[k + 1]] for k in full]),
                    _binary([count[cut[k]:cut[k + 1]].astype(np.uint32) for k in full])], names=["bucket", "chunk", "grams", "counts"])
    return run


def _answer(asked: pa.Table) -> pa.Table:
    """To each chunk: its n-grams that two sets or more hold, and how many do."""
    grams, counts = _column(asked, "grams", np.uint64), _column(asked, "counts", np.uint32)
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts).astype(np.float64), minlength=len(every)).astype(np.int64)[at]
    cut = np.cumsum([0, *map(len, grams)])
    held = [np.flatnonzero(total[a:b] > 1) for a, b in zip(cut, cut[1:])]
    return pa.table({"chunk": asked.column("chunk"), "grams": _binary([g[h] for g, h in zip(grams, held)]),
                     "counts": _binary([total[a:b][h] for a, b, h in zip(cut, cut[1:], held)])})


def _post(least_of, rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The sets of a chunk that share as many n-grams with others as a link
    asks for, each with the n-grams it is posted under: the rarest, as many as
    are needed to meet any partner's."""
    schema = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("grams", pa.binary())])
    if not len(rows) or not len(answers):
        return schema.empty_table()
    known, count = np.concatenate(_column(answers, "grams", np.uint64)), np.concatenate(_column(answers, "counts", np.int64))
    if not len(known):
        return schema.empty_table()
    order = np.argsort(known)
    known, count = known[order], count[order]
    keys, stay = [], []
    for k, (n, gram) in enumerate(zip(rows.column("n").to_pylist(), _column(rows, "grams", np.uint64))):
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        df = np.where(known[at] == gram, count[at], 1)
        shared, least = np.flatnonzero(df > 1), least_of(n)
        if len(shared) >= least:
            rare = shared[np.lexsort((gram[shared], df[shared]))][:len(shared) - least + 1]
            keys.append(gram[rare].view(np.int64))
            stay.append(k)
    rows = rows.take(pa.array(stay, pa.int64()))
    return pa.table([rows.column("uid"), rows.column("n"), pa.array(keys, pa.list_(pa.int64())), rows.column("grams")], schema=schema)


def _posted(sets: DataFrame, least_of, grams: bool) -> DataFrame:
    """``sets`` (chunk, uid, n, grams; a chunk's rows stand together) reduced to
    those that may have a partner: uid, n, and if asked for keys and grams."""
    total = sets.agg(F.sum(F.length("grams"))).first()[0] or 0
    buckets = max(1, -(-(total // 8) // BUCKET_GRAMS))
    answers = sets.select("chunk", "grams").mapInArrow(_ask(buckets), "bucket long, chunk long, grams binary, counts binary") \
        .groupBy("bucket").applyInArrow(_answer, "chunk long, grams binary, counts binary")
    cols, post = ("uid", "n", "keys", "grams") if grams else ("uid",), partial(_post, least_of)
    kinds = {"uid": "long", "n": "long", "keys": "array<long>", "grams": "binary"}
    return staged(sets.groupBy("chunk").cogroup(answers.groupBy("chunk"))
                  .applyInArrow(lambda r, a: post(r, a).select(list(cols)), ", ".join(f"{c} {kinds[c]}" for c in cols)), "posted")


class PrefixTree:
    """Sets in a trie with joined edges, in one element order."""

    def __init__(self, sets: list[np.ndarray]):
        every, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, -count))] = np.arange(len(every))
        alone = count[at] == 1
        cut = np.cumsum([0, *map(len, sets)])
        self.size = np.diff(cut)
        # elements of one set only share nothing: they are no part of a path
        paths = [np.sort(rank[at[a:b]][~alone[a:b]]) for a, b in zip(cut, cut[1:])]
        keys = [p.astype(">u4").tobytes() for p in paths]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        self.path = [paths[i] for i in self.order]
        self.n = self.size[self.order]
        self.mark = np.zeros(len(every) + 1, bool)
        length = np.array([len(p) for p in self.path], np.int64)
        same = np.zeros(len(sets) + 1, np.int64)
        for i in range(1, len(sets)):
            m = min(length[i - 1], length[i])
            diff = self.path[i - 1][:m] != self.path[i][:m]
            same[i] = int(diff.argmax()) if diff.any() else m
        #: (first set, end, depth above, depth below, least size, longest path, children)
        self.nodes: list[tuple] = []
        stack = [(0, len(sets), 0, -1)]
        children: list[list[int]] = []
        while stack:
            lo, hi, above, parent = stack.pop()
            below = int(same[lo + 1:hi].min()) if hi - lo > 1 else int(length[lo])
            node = len(self.nodes)
            self.nodes.append((lo, hi, above, below, int(self.n[lo:hi].min()), int(length[lo:hi].max())))
            children.append([])
            if parent >= 0:
                children[parent].append(node)
            if hi - lo > 1:
                if length[lo:hi].max() == below:  # all end here
                    continue
                cuts = [lo, *(lo + 1 + np.flatnonzero(same[lo + 1:hi] == below)).tolist(), hi]
                stack += [(a, b, below, node) for a, b in zip(cuts, cuts[1:])]
        self.children = children

    def links(self, label: np.ndarray, threshold: int) -> list[tuple[int, int]]:
        """Links that join sets of different labels, until all that are linked
        share a label.  ``label`` is by input place and is updated."""
        lab, found = label[self.order], []
        for x in range(len(self.path)):
            path, n = self.path[x], int(self.n[x])
            if (lab == lab[x]).all():
                break
            self.mark[path] = True
            stack = [(0, 0)]
            while stack:
                node, overlap = stack.pop()
                lo, hi, above, below, least, longest = self.nodes[node]
                if (lab[lo:hi] == lab[x]).all():
                    continue
                rest = len(path)
                if below > above:
                    edge = self.path[lo][above:below]
                    overlap += int(self.mark[edge].sum())
                    rest -= int(np.searchsorted(path, edge[-1], side="right"))
                elif above:
                    rest -= int(np.searchsorted(path, self.path[lo][above - 1], side="right"))
                if overlap + min(rest, longest - below) < -(-threshold * (n + least) // (100 + threshold)):
                    continue
                if self.children[node]:
                    stack += [(c, overlap) for c in self.children[node]]
                    continue
                for y in range(lo, hi):
                    if lab[y] != lab[x] and overlap * (100 + threshold) >= threshold * (n + int(self.n[y])):
                        found.append((int(self.order[x]), int(self.order[y])))
                        lab[lab == lab[y]] = lab[x]
            self.mark[path] = False
        label[self.order] = lab
        return found


def _join(threshold: int, block: pa.Table) -> pa.Table:
    """Links within a block (uid, label, grams): each joins two components."""
    uid = block.column("uid").to_numpy()
    _, first = np.unique(uid, return_index=True)
    uid = uid[first]
    grams = _column(block, "grams", np.uint64)
    _, label = np.unique(block.column("label").to_numpy()[first], return_inverse=True)
    found = PrefixTree([grams[i] for i in first]).links(label, threshold) if len(first) > 1 else []
    return pa.table({"u": pa.array([uid[a] for a, _ in found], pa.int64()), "v": pa.array([uid[b] for _, b in found], pa.int64())})


def _blocks(sets: DataFrame, group: str) -> DataFrame:
    """``sets`` (uid, label, n, grams, group) with the blocks of each group, cut
    by a hash so that none is too large; ``blocks`` is their number."""
    count = staged(sets.groupBy(group).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_GRAMS)).cast("long").alias("blocks"),
                                           F.count(F.lit(1)).alias("members")).where("members > 1"), "blocks")
    return sets.join(count.select(group, "blocks"), group).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))


def _linked(sets: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    return sets.select(*keys, "uid", "label", "grams").groupBy(*keys).applyInArrow(lambda t: _join(threshold, t), "u long, v long")


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, label) of ``sets`` after ``links``."""
    return staged(sets.join(components(links), sets["uid"] == F.col("node"), "left").select("uid", F.coalesce("label", "uid").alias("label")), "labels")


def similar_sets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): per row uid, doc_id, n, digest; per distinct set
    digest, uid (of its representative) and its smallest doc_id; links between
    representatives, enough to connect all that are linked."""
    if not 1 <= threshold <= 100:
        raise ValueError("threshold is a percentage")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.monotonically_increasing_id().alias("uid"), plain(id_col)[0].alias("doc_id"), text_bytes(f"`{text_col}`").alias("text"))
    sketch = staged(src.mapInArrow(_sketch(size, threshold), f"uid long, doc_id {kind}, n long, digest string, grams binary"), "sketch")
    rows = staged(sketch.drop("grams"), "rows")
    classes = staged(rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least")), "classes")

    # first by a share of each set, then by whole sets of what is left
    chunk = F.shiftright("uid", CHUNK_BITS).alias("chunk")
    reps = staged(sketch.where("n > 0").select(chunk, "uid", "n", "grams").groupBy("chunk").cogroup(classes.select(chunk, "uid").groupBy("chunk"))
                  .applyInArrow(_only, "chunk long, uid long, n long, grams binary"), "representatives")
    release(sketch)
    maybe = _posted(reps, lambda n: kept(n, threshold)[1], grams=False)
    release(reps)
    # read again by the id of their document
    wanted = staged(maybe.join(classes.select("uid", "digest"), "uid").join(rows.select("uid", F.col("doc_id").alias("id")), "uid"), "wanted")
    text = docs.select(plain(id_col)[0].alias("id"), text_bytes(f"`{text_col}`").alias("text")).mapInArrow(_squeeze, f"id {kind}, text binary")
    # one plan at every size: a broadcast of the wanted ids would hold for small tables only
    full = text.join(wanted.hint("merge"), text["id"].eqNullSafe(wanted["id"])).select("uid", "digest", "text")
    sets = staged(full.mapInArrow(_full(size), "chunk long, uid long, n long, grams binary"), "sets")
    posts = _posted(sets, lambda n: least_overlap(n, threshold), grams=True)
    release(sets)

    posting = posts.select("uid", F.explode("keys").alias("key"))
    heads = staged(posting.groupBy("key").agg(F.min("uid").alias("head"), F.max("uid").alias("last")).where("head <> last").select("key", "head"), "heads")
    stars = posting.join(heads, "key").where("uid <> head").select(F.col("uid").alias("u"), F.col("head").alias("v")).distinct()
    groups = components(stars)
    sets = posts.join(groups.toDF("uid", "grp"), "uid").select("uid", "n", "grams", "grp", F.col("uid").alias("label"))

    cut = _blocks(sets, "grp")
    links = staged(_linked(cut, ["grp", "block"], threshold), "links")
    large = staged(cut.where("blocks > 1").select("uid", "grp").distinct(), "large")
    if large.isEmpty():
        return rows, classes, links
    sets = staged(sets.join(large.select("uid"), "uid", "left_semi"), "large-sets").drop("grp")
    for _ in range(3):  # bridges between the blocks of a group
        now = _labelled(large, links)
        reps = sets.drop("label").join(now.where("uid = label"), "uid").join(large, "uid")
        more = staged(_linked(_blocks(reps, "grp"), ["grp", "block"], threshold), "links")
        if more.isEmpty():
            break
        links = staged(links.unionByName(more), "links")
    member = posting.join(_labelled(large, links), "uid")
    open_ = staged(member.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("m"))
                   .where("a <> b").select("key", F.ceil(F.col("m") / (BLOCK_SETS // 2)).cast("long").alias("parts")), "open")
    if open_.isEmpty():
        return rows, classes, links
    part = F.pmod(F.xxhash64("uid"), F.col("parts"))
    pairs = member.join(open_, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "uid", "label")
    more = _linked(pairs.join(sets.select("uid", "grams"), "uid"), ["key", "i", "j"], threshold)
    return rows, classes, staged(links.unionByName(more), "links")


def similar_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, its own included)."""
    rows, classes, links = similar_sets(docs, text_col, id_col, size, threshold)
    label = components(links)
    of_class = classes.join(label, classes["uid"] == label["node"], "left").select("digest", "least", F.coalesce("label", "uid").alias("label"))
    least = staged(of_class.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    known = staged(of_class.join(least, "label").select("digest", "component_id"), "class-components")
    return rows.join(known, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The documents whose id is the smallest of their component."""
    id_col = kw.get("id_col", "doc_id")
    return rows_with_id(docs, similar_documents(docs, **kw).where("component_id <=> doc_id").select("doc_id"), id_col, keep=True)
