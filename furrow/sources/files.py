"""Partitioned scans and file readers (ops 1.1-1.4, 1.9, 1.10, 1.12, 1.14, 1.15).

Layered store layout: ``<root>/<layer>/<grain>/<source>/`` with Hive-style
``year=/month=/day=`` (or ``year=``) folders and a ``location`` column.
Partition filters are plain equality/IN predicates on partition columns,
so Spark prunes folders before listing files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingPartition(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def layer_path(root: str, layer: str, grain: str, source: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{grain}/{source}"


def read_partition(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   strict: bool = False, **parts) -> DataFrame:
    """One partition (``year=, month=, day=``) of a partitioned dataset (ops 1.1, 1.2, 1.4).

    Absent data gives an empty frame with ``schema`` (or raises when
    ``strict``; the yearly and forecast readers are strict).
    """
    if not _exists(spark, path):
        if strict or schema is None:
            raise MissingPartition(path)
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    for k, v in parts.items():
        df = df.where(F.col(k) == F.lit(v))
    if strict and df.limit(1).count() == 0:
        raise MissingPartition(f"{path} {parts}")
    return df


def read_years(spark: SparkSession, path: str, years: Sequence[int], ts_col: str = "date",
               floor_day: bool = False) -> DataFrame:
    """Many years as one frame (ops 1.3, 8.1): one pruned scan instead of a
    union of per-year reads; optionally floors the key to the day."""
    df = spark.read.parquet(path).where(F.col("year").isin([int(y) for y in years]))
    if floor_day:
        df = df.withColumn(ts_col, F.date_trunc("day", F.col(ts_col)))
    return df


def stamp_source(df: DataFrame, source: str, extraction_date=None) -> DataFrame:
    """Add ``source`` and a default ``extraction_date`` when absent (op 1.4, 3.14)."""
    out = df.withColumn("source", F.lit(source))
    if extraction_date is not None:
        default = F.lit(extraction_date).cast("date")
        if "extraction_date" in df.columns:
            out = out.withColumn("extraction_date", F.coalesce(F.col("extraction_date"), default))
        else:
            out = out.withColumn("extraction_date", default)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema (op 1.9; no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_csv_skip_preamble(spark: SparkSession, path: str, schema: T.StructType | str,
                           skip_lines: int = 2, renames: Mapping[str, str] | None = None,
                           date_cols: Sequence[str] = ()) -> DataFrame:
    """CSV exports with ``skip_lines`` preamble lines before the header (op 1.10).

    Files are read line by line and split over tasks like any text (compressed
    ones are not split, but still read line by line).  Each line knows its file
    and the start of its block; a small aggregate finds the row at which every
    file's first block begins, and the preamble and header are the rows right
    behind it.  Lines are parsed with ``from_csv`` against ``schema`` (already in
    target column order); ``renames`` maps export headers to schema names; dates
    are cast to DATE.  A line end inside quotes is not supported.
    """
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1].replace(":", " ")
    # rows of a block are numbered in the order of its lines; both readings of the
    # unchanged files deal the same blocks to the same tasks
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    first = lines.where("block = 0").groupBy("file").agg(F.min("row").alias("first"))
    body = lines.join(first, "file").where(((F.col("block") > 0) | (F.col("row") > F.col("first") + skip_lines)) & (F.trim("line") != ""))
    parsed = body.select(F.from_csv("line", ddl).alias("r")).select("r.*")
    if renames:
        parsed = parsed.withColumnsRenamed(dict(renames))
    for c in date_cols:
        parsed = parsed.withColumn(c, F.to_date(F.col(c)))
    return parsed


# Catalogue record fields read from each XML dataset element.
CATALOG_XML_SCHEMA = T.StructType([
    T.StructField("_xml:id", T.StringType()),
    T.StructField("dc:identifier", T.StringType()),
    T.StructField("dc:title", T.StringType()),
    T.StructField("dc:description", T.StringType()),
    T.StructField("dc:creator", T.StringType()),
    T.StructField("dc:publisher", T.StringType()),
    T.StructField("dct:modified", T.StringType()),
    T.StructField("dc:subject", T.ArrayType(T.StringType())),
    T.StructField("dcat:distribution", T.ArrayType(T.StructType([
        T.StructField("dcat:Distribution", T.StructType([
            T.StructField("dcat:downloadURL", T.StringType())]))]))),
])

CATALOG_FIELDS = {"identifier": "dc:identifier", "title": "dc:title", "description": "dc:description",
                  "creator": "dc:creator", "publisher": "dc:publisher", "modified": "dct:modified"}


def read_catalog_xml(spark: SparkSession, path: str, row_tag: str = "dcat:Dataset",
                     schema: T.StructType = CATALOG_XML_SCHEMA) -> DataFrame:
    """Dataset catalogue XML to records (op 1.12): ``id`` from the ``xml:id``
    attribute (``Unknown`` when absent), six text fields defaulting to '',
    repeated ``dc:subject`` to an array (empty texts dropped), first download URL."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    subjects = F.filter(F.coalesce(F.col("`dc:subject`"), F.array().cast("array<string>")),
                        lambda x: x.isNotNull() & (x != ""))
    return raw.select(
        F.coalesce(F.col("`_xml:id`"), F.lit("Unknown")).alias("id"),
        *[F.coalesce(F.col(f"`{src}`"), F.lit("")).alias(dst) for dst, src in CATALOG_FIELDS.items()],
        subjects.alias("subjects"),
        F.col("`dcat:distribution`")[0].getField("dcat:Distribution").getField("dcat:downloadURL").alias("download_url"))


def param_sql(spark: SparkSession, query: str, args: Mapping[str, object] | None = None,
              frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Parameterised SQL (op 1.14): values are bound as ``:name`` parameters,
    never pasted into the text; DataFrames are bound to ``{name}`` placeholders
    (no session-wide temp views are created)."""
    return spark.sql(query, args=dict(args or {}), **dict(frames or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Relational table as a source (op 1.15), read in parallel ranges when a
    numeric partition column is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    return r.load()
