"""Versioned incremental tables: whole switches, replay, pruned batches, fills over batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.fill import ffill
from furrow.streaming import versions as V

SCHEMA = "location string, date date, t double, extraction int"
DAY = dt.date(2024, 1, 1)


def _rows(df):
    return sorted(tuple(r) for r in df.select("location", "date", "t").collect())


def _merge(spark, path, rows, batch=None):
    return V.merge_batch(spark.createDataFrame(rows, SCHEMA), path, ["location", "date"], ["extraction"], "date", batch=batch)


def test_one_day_batch_reads_and_writes_one_partition(spark, tmp_dir):
    path = tmp_dir + "/facts"
    days = [DAY + dt.timedelta(d) for d in range(5)]
    assert _merge(spark, path, [(s, d, 1.0, 1) for s in "ab" for d in days]) == 1
    first = V._record(spark, path)["parts"]
    assert _merge(spark, path, [("a", days[2], 9.0, 2), ("c", days[2], 5.0, 2), ("b", days[2], 0.0, 0)]) == 2
    second = V._record(spark, path)["parts"]
    assert [p for p in first if first[p] != second[p]] == [str(days[2])]
    files = V.read_version(spark, path, parts=[str(days[2])]).inputFiles()
    assert files and all(f"p={days[2]}" in f for f in files)
    got = _rows(V.read_version(spark, path))
    assert ("a", days[2], 9.0) in got and ("b", days[2], 1.0) in got and len(got) == 11  # an older extraction loses
    assert len(_rows(V.read_version(spark, path, version=1))) == 10  # earlier versions stay readable


def test_batch_killed_before_the_switch_is_replayed_without_loss(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/facts"
    _merge(spark, path, [("a", DAY, 1.0, 1)], batch=0)
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            _merge(spark, path, [("a", DAY, 2.0, 2), ("b", DAY, 3.0, 2)], batch=1)
    assert _rows(V.read_version(spark, path)) == [("a", DAY, 1.0)]  # nothing of the dead batch is seen
    assert _merge(spark, path, [("a", DAY, 2.0, 2), ("b", DAY, 3.0, 2)], batch=1) == 2
    assert _rows(V.read_version(spark, path)) == [("a", DAY, 2.0), ("b", DAY, 3.0)]
    assert _merge(spark, path, [("a", DAY, 7.0, 9)], batch=1) == 2  # switched already: left alone
    gone = V.vacuum(spark, path, keep=1)
    assert len(gone) == 2 and _rows(V.read_version(spark, path)) == [("a", DAY, 2.0), ("b", DAY, 3.0)]


def test_a_lost_race_merges_again_on_top_of_the_winner(spark, tmp_dir, monkeypatch):
    path, real, raced = tmp_dir + "/facts", V._commit, []

    def late(spark_, p, rec):
        if not raced:
            raced.append(1)
            _merge(spark, path, [("x", DAY, 4.0, 1)])
        return real(spark_, p, rec)

    _merge(spark, path, [("a", DAY, 1.0, 1)])
    monkeypatch.setattr(V, "_commit", late)
    assert _merge(spark, path, [("b", DAY, 2.0, 1)]) == 3
    assert _rows(V.read_version(spark, path)) == [("a", DAY, 1.0), ("b", DAY, 2.0), ("x", DAY, 4.0)]


def test_odd_partition_names_nulls_and_no_table(spark, tmp_dir):
    path = tmp_dir + "/t"
    df = spark.createDataFrame([("a/b", 1), (None, 2), ("a b", 3), ("", 4), ("ok", 5), ("null", 6)], "k string, n int")
    V.merge_batch(df, path, ["k", "n"], ["n"], "k")
    assert sorted(r.n for r in V.read_version(spark, path).collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, tmp_dir + "/none")


def test_stream_restarts_where_it_stopped(spark, tmp_dir):
    landing, path, ckpt = tmp_dir + "/landing", tmp_dir + "/facts", tmp_dir + "/ckpt"
    schema = T._parse_datatype_string(SCHEMA)

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    def run():
        V.stream_merge(spark, landing, schema, path, ["location", "date"], ["extraction"], "date", checkpoint=ckpt, max_files_per_trigger=1)

    land([("s", DAY, 1.0, 1)])
    run()
    land([("s", DAY, 7.0, 5), ("t", DAY, 3.0, 5)])
    run()
    assert _rows(V.read_version(spark, path)) == [("s", DAY, 7.0), ("t", DAY, 3.0)]
    n = len(V.versions(spark, path))
    run()
    assert len(V.versions(spark, path)) == n == 2


def _facts(spark, path):
    return sorted(((r.k, r.at, r.v, r.v_filled) for r in V.read_version(spark, path + "/facts").collect()), key=repr)


def _whole(spark, rows):
    df = spark.createDataFrame(rows, "k string, at int, v double").withColumn("v_filled", F.col("v"))
    return sorted((tuple(r) for r in ffill(df, ["k"], ["at"], ["v_filled"]).collect()), key=repr)


def test_streamed_fills_equal_the_fill_of_all_rows(spark, tmp_dir, monkeypatch):
    rng = random.Random(4)
    rows = [(k, t, rng.choice([None, None, float(t)])) for k in "abc" for t in range(24)]
    on_time = [[r for r in rows if b * 6 <= r[1] < b * 6 + 6] for b in range(4)]
    held = [r for r in on_time[1] if r[0] == "b" and r[1] == 8]  # comes late, in the last batch
    on_time[1] = [r for r in on_time[1] if r not in held]
    on_time[3] += held

    def load(b, number):
        df = spark.createDataFrame(b, "k string, at int, v double").withColumn("day", F.floor(F.col("at") / 6).cast("int"))
        V.fill_batch(df, tmp_dir, ["k"], "at", ["v"], "day", number=number)

    for number, b in enumerate(on_time):
        if number == 2:  # stopped between the facts and the state, then replayed
            real = V._commit
            with monkeypatch.context() as m:
                m.setattr(V, "_commit", lambda s, p, rec: False if p.endswith("/state") else real(s, p, rec))
                with pytest.raises(RuntimeError):
                    load(b, number)
        load(b, number)
        assert _facts(spark, tmp_dir) == _whole(spark, [r for x in on_time[:number + 1] for r in x])
