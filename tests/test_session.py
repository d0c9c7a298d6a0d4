"""Session helpers: the shared folder, lineage cuts."""

import pytest

from furrow.session import checkpoint_root, cut_lineage


def test_unset_checkpoint_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            getConf = Conf

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_cut_lineage_writes_below_checkpoint_root(spark):
    df = spark.range(0, 50).selectExpr("id", "id * 2 as v")
    cut = cut_lineage(df, "unit")
    assert sorted(r.v for r in cut.collect()) == [2 * i for i in range(50)]
    root = checkpoint_root(spark).rstrip("/")
    files = cut.inputFiles()
    assert files and all(root.replace("file:", "") in f for f in files)


def test_spread_deals_a_scan_of_few_splits_and_leaves_others(spark, tmp_path):
    from furrow.session import spread
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spread(spark.read.parquet(str(tmp_path / "one")))
    assert one.rdd.getNumPartitions() == cores
    assert sorted(r.id for r in one.collect()) == list(range(100))
    many = spark.range(0, 100, 1, cores)
    assert spread(many) is many
