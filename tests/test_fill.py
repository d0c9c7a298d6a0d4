"""Fills against pandas on random series, with and without chunking."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from furrow.operators import fill


def _frame(seed=7, n_keys=6, n=60):
    rnd = random.Random(seed)
    rows = []
    for k in range(n_keys):
        for i in range(n):
            v = None if rnd.random() < 0.45 else round(rnd.uniform(-10, 40), 2)
            if k == 0:
                v = None  # all-null series
            rows.append((k, i, i // 7, v))
    return rows


def _pandas(rows, how):
    pdf = pd.DataFrame(rows, columns=["k", "i", "chunk", "v"]).sort_values(["k", "i"])
    out = {}
    for k, g in pdf.groupby("k"):
        s = g["v"].astype("float64").reset_index(drop=True)
        if how == "interp":
            r = s.interpolate(method="linear", limit_direction="both").ffill().bfill()
        elif how == "ffill":
            r = s.ffill()
        else:
            r = s.ffill().bfill()
        for i, v in zip(g["i"], r):
            out[(k, i)] = None if pd.isna(v) else round(float(v), 9)
    return out


def _spark(spark, rows, how, chunk):
    df = spark.createDataFrame(rows, "k int, i int, chunk int, v double")
    ch = F.col("chunk") if chunk else None
    fn = {"interp": fill.interpolate_linear, "ffill": fill.ffill, "both": fill.ffill_bfill}[how]
    res = fn(df, ["k"], ["i"], ["v"], chunk=ch).collect()
    return {(r.k, r.i): None if r.v is None else round(r.v, 9) for r in res}


def test_fills_match_pandas(spark):
    rows = _frame()
    for how in ("interp", "ffill", "both"):
        want = _pandas(rows, how)
        for chunk in (False, True):
            assert _spark(spark, rows, how, chunk) == want, (how, chunk)


def test_carry_forward_before(spark):
    rows = [(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, None), (2, 1, None), (2, 2, "c")]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    for chunk in (None, F.floor(F.col("i") / 2)):
        got = {(r.k, r.i): r.prev for r in fill.carry_forward_before(df, ["k"], ["i"], "v", "prev", chunk).collect()}
        assert got == {(1, 1): None, (1, 2): "a", (1, 3): "a", (1, 4): "b", (2, 1): None, (2, 2): None}


def test_edges_take_nearest(spark):
    rows = [(1, i, 0, v) for i, v in enumerate([None, None, 2.0, None, 6.0, None])]
    got = _spark(spark, rows, "interp", False)
    assert [got[(1, i)] for i in range(6)] == [2.0, 2.0, 2.0, 4.0, 6.0, 6.0]
    assert np.isclose(got[(1, 3)], 4.0)


def test_carry_all_before_equals_one_carry_per_column(spark):
    rows = [(k, i, "a%d" % i if i % 3 == 0 else None, i if i % 4 == 1 else None) for k in "xy" for i in range(12)]
    df = spark.createDataFrame(rows, "k string, i int, a string, b int")
    both = fill.carry_all_before(df, ["k"], ["i"], {"a": "pa", "b": "pb"})
    one = fill.carry_forward_before(fill.carry_forward_before(df, ["k"], ["i"], "a", "pa"), ["k"], ["i"], "b", "pb")
    assert sorted(both.select(*one.columns).collect(), key=str) == sorted(one.collect(), key=str)
    last = {(r.k, r.i): (r.pa, r.pb) for r in both.collect()}
    assert last["x", 0] == (None, None) and last["x", 6] == ("a3", 5) and last["y", 11] == ("a9", 9)
