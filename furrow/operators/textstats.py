"""Whole-text profile in stages (ops 9.22-9.28 as one plan).

Each stage is its own projection: the normalised text and its lower-cased
copy are computed once and every count reads them, instead of every flag
re-normalising the raw text.  (The optimizer keeps the stages apart because
the shared expressions are expensive and used several times.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import text as TX


def text_profile(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_sentences, n_digit_tokens, unit_hits, caution_hits,
    dense, too_long and the normalised text ``norm``."""
    keep = list(keep if keep is not None else df.columns)
    s1 = df.select(*keep, TX.collapse_ws(text_col).alias("norm"))
    s2 = s1.select("*", F.lower("norm").alias("__low"))
    s3 = s2.select(
        *keep, "norm",
        TX.word_count("norm", normalized=True).alias("n_words"),
        TX.sentence_count("norm", normalized=True).alias("n_sentences"),
        TX.digit_token_count("norm", normalized=True).alias("n_digit_tokens"),
        TX.marker_hits("__low", TX.UNIT_MARKERS, lowered=True).alias("unit_hits"),
        TX.marker_hits("__low", TX.CAUTION_MARKERS, lowered=True).alias("caution_hits"))
    dense = (F.col("n_digit_tokens") >= 3) | (F.col("unit_hits") >= 2) | (F.col("caution_hits") >= 3)
    s4 = s3.withColumn("dense", dense)
    return s4.withColumn("too_long", (F.col("norm") != "") & ~F.col("dense")
                         & ((F.col("n_sentences") > TX.MAX_SENTENCES) | (F.col("n_words") > TX.SHORTEN_TRIGGER_WORDS)))
