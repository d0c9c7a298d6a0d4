"""Location dimension: keys with six decimals, lasting ids, concurrent runs."""

from decimal import Decimal

import pytest

from furrow.operators import dimension as D


def _load(spark, path, rows):
    df = spark.createDataFrame(rows, "latitude double, longitude double, city_name string")
    return sorted((r.id, r.latitude, r.longitude, r.city_name) for r in D.get_or_create_locations(df, path).collect())


def test_second_run_adds_no_id_and_new_keys_follow(spark, tmp_dir):
    path = tmp_dir + "/location"
    rows = [(35.8256, 10.6411, "Sousse"), (36.8, 10.18, "Tunis"), (36.80000004, 10.18, "Tunis again"), (None, 1.0, "nowhere"), (4000.0, 1.0, "out")]
    one = _load(spark, path, rows)
    assert one == [(1, Decimal("35.825600"), Decimal("10.641100"), "Sousse"), (2, Decimal("36.800000"), Decimal("10.180000"), "Tunis")]
    assert _load(spark, path, rows[::-1]) == one
    two = _load(spark, path, [(34.0, 9.0, "Gafsa"), (36.8, 10.18, "renamed")])
    assert two == [*one, (3, Decimal("34.000000"), Decimal("9.000000"), "Gafsa")]  # known keys keep id and name


def test_concurrent_runs_share_no_id(spark, tmp_dir, monkeypatch):
    path, real, raced = tmp_dir + "/location", D._claim, []

    def late(spark_, p, rec):
        if not raced:
            raced.append(1)
            _load(spark, path, [(1.0, 1.0, "other run"), (2.0, 2.0, "both")])
        return real(spark_, p, rec)

    monkeypatch.setattr(D, "_claim", late)
    got = _load(spark, path, [(2.0, 2.0, "both"), (0.5, 0.5, "mine")])
    assert [r[0] for r in got] == [1, 2, 3] and [r[3] for r in got] == ["other run", "both", "mine"]


def test_run_that_dies_leaves_the_table_as_it_was(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/location"
    one = _load(spark, path, [(1.0, 1.0, "a")])
    with monkeypatch.context() as m:
        m.setattr(D, "_claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            _load(spark, path, [(2.0, 2.0, "b")])
    assert _load(spark, path, []) == one
    assert _load(spark, path, [(3.0, 3.0, "c")])[1][0] == 2
    assert _load(spark, tmp_dir + "/empty", []) == []
