"""Indexed search, keyword hits once per id, one-pass catalogue report."""

from pyspark.sql import functions as F

from furrow.operators.dedup import any_match_dedup
from furrow.operators.keys import source_name
from furrow.operators.search import keyword_filter
from furrow.operators.search_index import build_index, search_index
from furrow.plans.catalog import catalog_report

ROWS = [(1, "Wheat and maize", "a"), (2, "wheatgrass", None), (3, None, "WHEAT"), (4, "éàü wheat é", "x"), (5, "whe at", ""), (6, "", "aa"), (2, "wheat again", "b")]


def _docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string, source string")


def test_index_gives_the_rows_of_a_scan(spark, tmp_dir):
    docs, words = _docs(spark), ["wheat", "Éàü", "aa", "e", "grass", "nothing", "wheat and maize"]
    path = build_index(docs, tmp_dir + "/index", "id", ["text", "source"], buckets=4)
    got = sorted((r.keyword, r.id, r.text or "") for r in search_index(docs, path, "id", ["text", "source"], words).collect())
    want = sorted((w.lower(), i, t or "") for w in words for i, t, s in ROWS if w.lower() in (t or "").lower() or w.lower() in (s or "").lower())
    assert got == want
    none = docs.where("false")
    path = build_index(none, tmp_dir + "/empty", "id", ["text"])
    assert search_index(none, path, "id", ["text"], words).count() == 0


def test_repeated_ids_count_and_show_once(spark):
    docs = _docs(spark)
    out = keyword_filter(docs, ["text", "source"], ["wheat"], "id").orderBy("id").collect()
    assert [(r.id, r.text) for r in out] == [(1, "Wheat and maize"), (2, "wheat again"), (3, None), (4, "éàü wheat é")]
    rows, counts = any_match_dedup(docs, "id", {"wheat": F.lower("text").contains("wheat"), "a": F.col("source") == "a"})
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 1), ("wheat", 3)]
    assert sorted(r.id for r in rows.collect()) == [1, 2, 4]


def test_report_in_one_scan(spark, tmp_dir):
    df = spark.createDataFrame([("TN", "x", 1), ("TN", "y", 0), (None, "x", None), ("FR", "x", 1), ("FR", "z", 1)], "c string, w string, u int")
    df.write.parquet(tmp_dir + "/t")
    out = catalog_report(spark.read.parquet(tmp_dir + "/t"), {"c": 2, "w": 1}, {"with_u": F.col("u") == 1})
    assert sorted((r.dim, r.value, r.n) for r in out.collect()) == [
        ("c", "FR", 2), ("c", "TN", 2), ("distinct", "c", 2), ("distinct", "w", 3), ("summary", "n_records", 5), ("summary", "with_u", 3), ("w", "x", 3)]


def test_source_names_keep_their_blanks(spark):
    df = spark.createDataFrame([("",), (None,), (" a ",), ("  ",)], "s string")
    assert [r[0] for r in df.select(source_name("s")).collect()] == ["unknown", "unknown", " a ", "  "]
