"""Jump shards, periodic runs and the prefix trie against plain versions."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, SF, odd_texts

from furrow.llm import common, periodic_runs, prefix_trie, queries, sharding


@pytest.fixture(scope="module")
def given(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    odd = [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    rows += odd + odd[20:24]  # rows that repeat
    marks = [(d, t, "en", "s%d" % (d % 3), len(t or ""), "clash", 5, 1, "h") for d, t in rows]
    return rows, spark.createDataFrame(marks, SCHEMA).repartition(5)


def test_running_figures_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, rng.randint(0, 50), rng.randint(-9, 9)) for _ in range(3000)] + [(rng.randint(0, 40), rng.randint(0, 50), rng.randint(-9, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(6).withColumn("x", F.col("v"))
    out = common.running(df, "g", ["o", "v"], sums=("v",), xors=("x",))
    got = sorted(tuple(r) for r in out.select("g", "at", "ordinal", "o", "v", "run_v", "run_x").collect())
    want, groups = [], sorted({r[0] for r in rows})
    for k, g in enumerate(groups):
        total = mixed = 0
        for i, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            total, mixed = total + v, mixed ^ v
            want.append((g, i, k, o, v, total, mixed))
    assert got == want
    assert common.running(df.where("false"), "g", ["o"]).count() == 0


def test_jump_is_the_published_loop_and_moves_only_into_the_new_shard():
    keys = np.concatenate([np.arange(2000), np.random.default_rng(1).integers(0, 1 << 62, 500)]).astype(np.int64)
    for n in (1, 2, 15, 16, 17, 1000):
        assert sharding.jump(keys.view(np.uint64), n).tolist() == [brute.jump(int(k), n) for k in keys]
    old, new = sharding.jump(keys.view(np.uint64), 16), sharding.jump(keys.view(np.uint64), 17)
    assert set(new[new != old]) == {16} and 0 < (new != old).mean() < 0.12
    assert sharding.jump(np.array([-5], np.int64).view(np.uint64), 9).tolist() == [brute.jump((1 << 64) - 5, 9)]


def test_shards_hold_every_row_with_gapless_slots(spark, given):
    rows, docs = given
    clash = docs.withColumn("shard", F.lit("x")).withColumn("at", F.lit(1)).withColumn("piece", F.lit("p"))
    out = sharding.read_shards(spark, sharding.write_shards(clash, 16)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    assert {r.hash for r in out} == {"h"}
    slots = {}
    for r in out:
        assert r.shard == brute.jump(r.doc_id, 16)
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for s in slots.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s)))
        assert [d for _, d in sorted(s)] == sorted(d for _, d in s)


def test_shards_of_hot_null_and_textual_keys(spark):
    rows = [(5, "same")] * 3000 + [(None, None)] * 50 + [(i, "t%d" % i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sharding.read_shards(spark, sharding.write_shards(docs, 4)).collect()
    assert len(out) == len(rows) and len({(r.shard, r.slot) for r in out}) == len(rows)
    assert {r.shard for r in out if r.doc_id is None} == {brute.jump(0, 4)}
    by_text = sharding.read_shards(spark, sharding.write_shards(docs, 4, key=("text",))).collect()
    assert all(len({r.shard for r in by_text if r.text == t}) == 1 for t in ("same", None))
    assert sharding.read_shards(spark, sharding.write_shards(docs.where("false"), 4)).count() == 0


def test_grammar_extensions_are_exact():
    rng = random.Random(11)
    for size, letters in ((1, 1), (2, 1), (40, 1), (300, 2), (300, 3), (500, 40)):
        seq = np.array([rng.randrange(letters) for _ in range(size)] + [letters])
        seq = np.concatenate([seq, seq[:-1], [letters + 1]])
        g = periodic_runs.Grammar(seq)
        pairs = np.array([(i, j) for i in range(0, len(seq), 3) for j in range(i + 1, min(len(seq), i + 40))] + [(i, i + size + 1) for i in range(size)])
        ahead, behind = g.extension(pairs[:, 0], pairs[:, 1]), g.extension(pairs[:, 0], pairs[:, 1], back=True)
        for (i, j), a, b in zip(pairs.tolist(), ahead.tolist(), behind.tolist()):
            x = 0
            while j + x < len(seq) and seq[i + x] == seq[j + x]:
                x += 1
            y = 0
            while i - y > 0 and seq[i - y - 1] == seq[j - y - 1]:
                y += 1
            assert (a, b) == (x, y), (i, j)


def _plant(rng, letters):
    out = []
    for _ in range(rng.randint(0, 6)):
        out += [rng.randrange(letters) for _ in range(rng.randint(0, 12))]
        base = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        out += (base * 9)[:rng.randint(0, 9 * len(base))]
    return out


def test_runs_are_those_of_the_definition():
    rng = random.Random(5)
    for letters in (1, 2, 3, 8, 1000):
        texts = sorted((_plant(rng, letters) for _ in range(60)), key=len, reverse=True)
        lens = np.array([len(t) for t in texts])
        seq = np.concatenate([np.array([*t, 10_000 + k], np.int64) for k, t in enumerate(texts)])
        begin = np.cumsum(lens + 1) - lens - 1
        runs = sorted(map(tuple, periodic_runs.runs_of(seq, lens).tolist()))
        assert runs == sorted((int(b) + s, n, q) for b, t in zip(begin, texts) for s, n, q in brute.periodic_runs(t))


def test_periodic_runs_query(spark, given):
    rows, docs = given
    rng = random.Random(9)
    more = [(20_000 + i, " ".join("w%d" % x for x in _plant(rng, 4))) for i in range(400)]
    rows = [r for r in rows if len(r[1] or "") < 60_000] + more
    made = queries.repeated_words(docs.where("length(coalesce(text, '')) < 60000").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")))
    out = queries.runs_digest(periodic_runs.find_runs(made))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(brute.run_rows(rows), key=repr)


def test_periodic_runs_of_one_very_long_text_and_no_rows(spark):
    text = "a b c " * 60_000 + "x " + "d e " * 100
    docs = spark.createDataFrame([(None, text), (1, None), (2, "q q q q q q"), (3, "q q q q q")], "doc_id long, text string").withColumn("runs", F.lit(1))
    out = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in out[None].runs] == [(0, 180_000, 3), (180_001, 200, 2)] and out[None].collapsed == "a b c x d e"
    assert out[1].runs == [] and out[1].collapsed == "" and out[2].collapsed == "q" and out[3].runs == []
    assert periodic_runs.find_runs(docs.where("false")).count() == 0


def _trie(spark, rows, rebuild):
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn("depth", F.lit("clash"))
    out = prefix_trie.prefix_trie(*queries.rebuilt_conversations(convs)) if rebuild else prefix_trie.prefix_trie(prefix_trie.turn_rows(convs))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_trie_of_given_and_odd_conversations(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(2)
    for c in range(1000, 1300):  # copies, ties, nulls, a common first turn
        n = rng.randint(1, 5)
        rows += [(c, rng.choice([None, k, k, 1]), rng.choice(["user", None]), rng.choice(["hi there", "a b", None, "", " x\ty ", "ab"])) for k in range(n)]
    rows += [(None, 1, "user", "nobody"), (rows[0][0], *rows[0][1:])]
    assert _trie(spark, rows, True) == sorted(brute.trie(rows), key=repr)


def test_trie_of_turnless_and_of_no_conversations(spark):
    own = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 2)  # its head, 20, is absent
    rows = [(own, 0, "user", "gone")]
    assert _trie(spark, rows, True) == sorted(brute.trie(rows), key=repr)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.turn_rows(empty)).count() == 0


def test_trie_of_long_conversations_over_shards(spark):
    n = prefix_trie.STRETCH
    lengths = [n - 1, n, n + 1, 2 * n, 2 * n + 1, 700, 700, 3 * n]
    rows = [(c * 700, t, "user", "turn %d" % t if t < 520 or c % 2 else "other %d" % t) for c, m in enumerate(lengths) for t in range(m)]
    rows += [(c, 0, "user", "turn 0") for c in range(10_001, 10_001 + 2 * prefix_trie.SHARD)]  # a third of all in one node, over three shards
    assert _trie(spark, rows, False) == sorted(brute.trie(rows, rebuild=False), key=repr)
