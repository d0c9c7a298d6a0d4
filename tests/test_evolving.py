"""Evolving files, sized ranges and the merge of many sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import fill, keys, ranges
from furrow.operators.merge import source_priority_merge
from furrow.sinks import evolving, partitioned


@pytest.fixture()
def small_target(spark):
    before = spark.conf.get(ranges.ADVISORY)
    spark.conf.set(ranges.ADVISORY, "2k")
    yield
    spark.conf.set(ranges.ADVISORY, before)


def test_widening():
    assert evolving.wider(T.IntegerType(), T.LongType()) == T.LongType()
    assert evolving.wider(T.DoubleType(), T.LongType()) == evolving.wider(T.LongType(), T.FloatType()) == T.DoubleType()
    assert evolving.wider(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    assert evolving.wider(T.NullType(), T.StringType()) == T.StringType()
    assert evolving.wider(T.StringType(), T.LongType()) is None


def test_loads_with_other_columns_and_types(spark, tmp_dir):
    path = tmp_dir + "/t"
    with pytest.raises(FileNotFoundError):
        evolving.read_evolving(spark, path)
    assert evolving.append_evolving(spark.createDataFrame([(1, 7)], "id int, t int"), path, "a")
    assert evolving.append_evolving(spark.createDataFrame([(2, 0.5, "x")], "ID long, rain double, note string"), path, "b")
    assert evolving.append_evolving(spark.createDataFrame([(3, 1.25)], "id int, t double").withColumn("note", F.lit(None)), path, "c")
    assert not evolving.append_evolving(spark.createDataFrame([(1, 7)], "id int, t int"), path, "a")
    out = evolving.read_evolving(spark, path)
    assert out.dtypes == [("id", "bigint"), ("t", "double"), ("rain", "double"), ("note", "string")]
    assert sorted(map(tuple, out.collect())) == [(1, 7.0, None, None), (2, None, 0.5, "x"), (3, 1.25, None, None)]
    assert evolving.read_evolving(spark, path, version=1).dtypes == [("id", "int"), ("t", "int")]


def test_conflict_leaves_the_table(spark, tmp_dir):
    path = tmp_dir + "/t"
    evolving.append_evolving(spark.createDataFrame([(1, 7)], "id int, t int"), path, "a")
    with pytest.raises(TypeError, match="t: int and string"):
        evolving.append_evolving(spark.createDataFrame([(1, "z")], "id int, t string"), path, "b")
    assert evolving.read_evolving(spark, path).count() == 1


def test_load_that_dies_before_the_switch(spark, tmp_dir, monkeypatch):
    path, one = tmp_dir + "/t", spark.createDataFrame([(1,)], "id int")
    evolving.append_evolving(one, path, "a")

    def dies(self, name, text):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(evolving._Folder, "put", dies)
        with pytest.raises(OSError):
            evolving.append_evolving(one, path, "b")
    assert evolving.read_evolving(spark, path).count() == 1
    assert evolving.append_evolving(one, path, "b") and evolving.read_evolving(spark, path).count() == 2


def test_later_of_two_loads_meets_the_other_schema(spark, tmp_dir, monkeypatch):
    path, put, raced = tmp_dir + "/t", evolving._Folder.put, []

    def race(self, name, text):
        if not raced:
            raced.append(1)
            evolving.append_evolving(spark.createDataFrame([(0.5,)], "v double"), path, "other")
        return put(self, name, text)
    monkeypatch.setattr(evolving._Folder, "put", race)
    assert evolving.append_evolving(spark.createDataFrame([(2,)], "v int"), path, "mine")
    out = evolving.read_evolving(spark, path)
    assert out.dtypes == [("v", "double")] and sorted(r.v for r in out.collect()) == [0.5, 2.0]


def test_tasks_follow_bytes(spark):
    texts = lambda n, size: spark.range(n).select("id", F.repeat(F.lit("x"), size).alias("t"))
    assert ranges.range_tasks(texts(0, 10)) == 1 == ranges.range_tasks(texts(100, 10))
    assert ranges.range_tasks(texts(1000, 992), target=10_000) == 100
    assert ranges.range_tasks(texts(2000, 992), target=10_000) == 200
    assert ranges.range_tasks(spark.range(5000), [F.col("id")], target=1 << 30) > 10  # folders
    nested = spark.createDataFrame([([1] * 100, None)], "a array<int>, s string")
    assert ranges.range_tasks(nested, target=100) >= 2


def test_target_of_the_session(spark):
    before = spark.conf.get(ranges.ADVISORY)
    try:
        for text, want in (("2k", 2048), ("64MB", 64 << 20), ("1g", 1 << 30), ("100b", 100)):
            spark.conf.set(ranges.ADVISORY, text)
            assert ranges.target_bytes(spark.range(1)) == want
    finally:
        spark.conf.set(ranges.ADVISORY, before)


def test_hot_key_is_cut_by_bytes(spark, small_target):
    rows = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 97 == 0, F.col("id").cast("double")).alias("v"))
    assert ranges.range_tasks(rows) > 10
    got = [r.v for r in fill.ffill(rows, ["k"], ["i"], ["v"], chunk="range").orderBy("i").collect()]
    assert got == [float(i // 97 * 97) for i in range(2000)]
    ids = keys.dense_index(rows.select("i"), ["i"], start=5).orderBy("i").collect()
    assert [r.id for r in ids] == list(range(5, 2005))
    assert keys.dense_index(rows.where("false").select("i"), ["i"]).count() == 0


def test_hot_day_is_written_by_many_tasks(spark, small_target, tmp_dir):
    day = spark.range(2000).select(F.lit(dt.date(2024, 1, 1)).alias("date"), "id")
    partitioned.write_partitioned(day, tmp_dir + "/p", "date", ("year",), ["id"])
    files = spark.read.parquet(tmp_dir + "/p").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 10


def _sources(spark):
    schema = "date date, {} double, extraction_date date"
    day = lambda n: dt.date(2024, 1, n)
    a = spark.createDataFrame([(day(1), 1.0, day(9)), (day(2), None, day(9))], schema.format("t"))
    b = spark.createDataFrame([(day(2), 2.0, day(8)), (day(3), 3.0, day(8))], schema.format("t"))
    c = spark.createDataFrame([(day(2), 9.0, 5.0, day(10)), (None, 9.0, 6.0, day(7))], "date date, t double, rh double, extraction_date date")
    return [("a", a), ("b", b), ("c", c)]


def test_three_sources(spark):
    frames = _sources(spark)
    rows = lambda **kw: {r.date and r.date.day: (r.t, r.rh, r.extraction_date.day) for r in source_priority_merge(frames, **kw).collect()}
    assert rows() == {1: (1.0, None, 9), 2: (None, 5.0, 10), 3: (None, None, 8), None: (None, 6.0, 7)}
    assert rows(mode="coalesce") == {1: (1.0, None, 9), 2: (2.0, 5.0, 10), 3: (3.0, None, 8), None: (9.0, 6.0, 7)}
    assert set(rows(how="left")) == {1, 2} and set(rows(how="inner")) == {2}
    with pytest.raises(ValueError):
        rows(how="right")


def test_many_sources_move_rows_once(spark):
    plan = source_priority_merge(_sources(spark), mode="coalesce")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
