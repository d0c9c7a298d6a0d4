"""From raw documents to token files: five stages, each a training-data operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontaminate, mixing, ngram_join, token_ids, toxicity
from furrow.llm.common import rows_with_id, staged, table
from furrow.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    bad = toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id")
    return rows_with_id(docs, bad, "doc_id", keep=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, the smallest doc_id.
    Similar are texts that share 0.8 or more of their five-word shingles; the
    defaults of ``ngram_join`` are the contract of the query op7 alone."""
    return ngram_join.one_of_each(docs, size=5, threshold=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by raked source, language and topic weights."""
    return mixing.sample(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.read_ids(spark, token_ids.token_files(docs, tokenizer_path()), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_benchmark_passages),
          ("mixing", mix_sources), ("token_ids", write_tokens)]

#: a learned score and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
