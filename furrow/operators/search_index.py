"""Indexed substring search (ops 3.22, 3.23, 3.26): trigram postings written once.

``build_index`` writes one row per (three characters, record): whole lower-cased
texts, in buckets of the trigram and sorted by it, so that a lookup opens the
buckets it asks for and skips row groups; beside them the number of records per
trigram.  A trigram that most records hold is many rows over many tasks, never one
list.  ``search_index`` looks up the rarest trigrams of every keyword, keeps
records that hold all of them, and verifies these few against the texts with
``contains``: the same rows as a scan per keyword.  Keywords of one or two
characters have no trigram and are searched in the texts themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAREST = 3


def _grams(text: Column) -> Column:
    """Distinct three characters in a row; the text is cut into characters a fixed number of times, whatever its length."""
    chars, n = F.split(text, ""), F.length(text) + 1
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(F.zip_with(pairs, F.slice(chars, F.lit(3), n), lambda a, b: F.concat(a, b))))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build_index(df: DataFrame, path: str, id_col: str, fields: Sequence[str], buckets: int = 32) -> str:
    """Postings and counts of the lower-cased ``fields``, each searched on its own, below ``path``."""
    grams = F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams(F.lower(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields]))))
    rows = df.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
    df.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")
    return path


def candidates(spark: SparkSession, path: str, keywords: Sequence[str], id_type: str = "long") -> DataFrame:
    """(keyword, id) of records that hold the rarest trigrams of a keyword."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    asked = sorted({(k, k[i:i + 3]) for k in keywords for i in range(len(k) - 2)})
    grams = spark.createDataFrame(asked, "keyword string, gram string").withColumn("bucket", _bucket(F.col("gram"), buckets))
    counts = spark.read.schema("gram string, n long").parquet(f"{path}/counts")
    # a handful of rows per keyword: its grams with their counts (none: no record holds it)
    known = [(r.keyword, r.gram, r.bucket, r.n or 0) for r in grams.join(counts, "gram", "left").collect()]
    picked = []
    for k in sorted({r[0] for r in known}):
        mine = sorted((r for r in known if r[0] == k), key=lambda r: (r[3], r[1]))[:RAREST]
        picked += [(k, g, b, len(mine)) for _, g, b, _ in mine]
    wanted = spark.createDataFrame(picked, "keyword string, gram string, bucket int, need int")
    postings = spark.read.schema(f"id {id_type}, gram string, bucket int").parquet(f"{path}/postings") \
        .where(F.col("bucket").isin(sorted({b for _, _, b, _ in picked})) & F.col("gram").isin(sorted({g for _, g, _, _ in picked})))
    # a record may be listed once per row that repeats it
    return postings.join(F.broadcast(wanted), ["gram", "bucket"]).groupBy("keyword", "id", "need").agg(F.count_distinct("gram").alias("n")) \
        .where("n = need").select("keyword", "id")


def search_index(df: DataFrame, path: str, id_col: str, fields: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """(keyword, row of ``df``) for every keyword and record that holds it in a
    field, in either case."""
    spark = df.sparkSession
    low = sorted({k.lower() for k in keywords if k})
    texts = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    kind = df.schema[id_col].dataType.simpleString()
    found = df.join(candidates(spark, path, [k for k in low if len(k) > 2], kind).withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id")).drop("__id")
    short = [k for k in low if len(k) < 3]
    if short:
        found = found.unionByName(df.select(F.explode(F.array(*map(F.lit, short))).alias("keyword"), "*").select(*found.columns))
    verified = F.lit(False)
    for t in texts:
        verified = verified | F.contains(t, F.col("keyword"))
    return found.where(verified)
