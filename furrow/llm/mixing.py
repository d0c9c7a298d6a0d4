"""Mixing sources to target weights (operator 2), DataFrame functions only.

Token weights are raked by iterative proportional fitting: documents are
summed into cells (source, language, topic); cell weights are scaled to each
marginal in turn until all three match their targets.  A document's sampling
probability is its cell's fitted weight over the cell's own tokens, at most 1,
calibrated so that the sample is expected to hold ``KEEP`` of all tokens.  A
hash of the doc_id decides: the draw is the same on every retry.

Scale.  One narrow pass over the texts and one aggregate that combines in the
tasks first; a source that holds a third of all rows is a handful of cells.
All fitting runs on cells and marginals, never on documents.  The cells are
joined back to (doc_id, cell key) rows; Spark broadcasts them only if their
size is below its threshold, else AQE splits a hot cell.

Targets: a share per value, or by default the value's own token share raised to
``TEMPER`` (so a dominant source is toned down).  Values that a given target
does not name share what is left of 1 in proportion to their tokens (nothing,
if nothing is left).

Defined cases: null source, language or topic is a value of its own; empty and
null texts weigh one token; a null doc_id draws by the hash of the empty text;
rows that repeat draw alike; an empty table gives an empty result; further
columns are kept by ``sample``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import plain, rows_with_id, staged

DIMS = ("source", "lang", "topic")
TEMPER = 0.8
SWEEPS = 8
KEEP = 0.9
CALIBRATION = 30
SEED = "furrow-mix"

#: topic by what a whole text holds, the first that fits
TOPICS = (("contact", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]|\+[0-9][\x20().0-9-]{7,}"),
          ("license", r"(?i)licen[sc]e|copyright|warranty"),
          ("config", r"(?i)(?:password|secret|token|api_?key)[\"']?\x20*[:=]"),
          ("numeric", r"[0-9]{6,}"),
          ("markup", r"[#$%&*|{}<>]{2,}"))


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words between blanks and line ends, at least one."""
    return F.greatest(F.lit(1), F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 13 hex digits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _targets(cells: DataFrame, dim: str, given: Mapping[str, float] | None, temper: float) -> DataFrame:
    """(dim, target): shares that sum to 1."""
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"))
    if given:
        named = F.lit(None).cast("double")
        for value, share in given.items():
            named = F.when(F.col(dim) == value, float(share)).otherwise(named)
        left = max(0.0, 1.0 - sum(given.values()))
        own = own.withColumn("named", named)
        rest = own.agg(F.sum(F.when(F.col("named").isNull(), F.col("tokens"))).alias("rest"))
        own = own.crossJoin(F.broadcast(rest))  # one row
        raw = F.coalesce("named", F.lit(left) * F.col("tokens") / F.col("rest"))
    else:
        raw = F.pow("tokens", F.lit(temper))
    own = own.select(dim, raw.alias("raw"))
    total = own.agg(F.sum("raw").alias("total"))  # one row
    return own.crossJoin(F.broadcast(total)).select(dim, (F.col("raw") / F.col("total")).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, tokens, weight): fitted shares of the whole.
    ``cells`` holds source, lang, topic, tokens."""
    cells = staged(cells, "cells")
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMS:
        goal = staged(_targets(cells, d, (targets or {}).get(d), temper), f"target-{d}")
        now = now.join(goal.toDF(f"v_{d}", f"target_{d}"), F.col(d).eqNullSafe(F.col(f"v_{d}"))).drop(f"v_{d}")
    now = staged(now, "targets")
    for sweep in range(sweeps):
        # one join per plan: a plan that goes on from the last one reads it twice
        for d in DIMS:
            have = now.groupBy(F.col(d).alias("v")).agg(F.sum("weight").alias("have"))
            scale = F.when(F.col("have") > 0, F.col(f"target_{d}") / F.col("have")).otherwise(0.0)
            now = staged(now.join(have, F.col(d).eqNullSafe(F.col("v"))).withColumn("weight", F.col("weight") * scale).drop("v", "have"), f"rake-{sweep}-{d}")
    return now.select(*DIMS, "tokens", "weight")


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability), rounded to 9 places.
    The probability of a cell is its weight over its tokens times a scale, at
    most 1.  The scale is calibrated so that the expected tokens of the sample
    are ``budget``: what cells that reach 1 cannot give is given by the rest."""
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    scale = 0.0
    for _ in range(CALIBRATION):  # each round is one aggregate over the cells
        full = F.col("ratio") * scale >= 1.0
        got = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        scale, last = max(scale, (budget - (got["full"] or 0)) / got["open"]), scale
        if scale == last:
            break
    return cells.select(*DIMS, "tokens", "weight", F.round(F.least(F.lit(1.0), F.col("ratio") * scale), 9).alias("probability"))


def mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, text_col: str = "text", id_col: str = "doc_id",
            source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, keep: float = KEEP,
            temper: float = TEMPER, sweeps: int = SWEEPS, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, n_tokens, probability, kept."""
    text = F.coalesce(plain(text_col)[0].cast("string"), F.lit(""))
    rows = staged(docs.select(plain(id_col)[0].alias("doc_id"), plain(source_col)[0].cast("string").alias("source"), plain(lang_col)[0].cast("string").alias("lang"),
                              (topic_of(text) if topic is None else topic.cast("string")).alias("topic"), tokens_of(text).alias("n_tokens")), "mix")
    fitted = rake(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), targets, temper, sweeps)
    cells = probabilities(fitted, keep * (fitted.agg(F.sum("tokens")).first()[0] or 0))
    cells = staged(cells, "mix-cells").select(*[F.col(d).alias(f"c_{d}") for d in DIMS], "probability")
    same = F.expr(" AND ".join(f"{d} <=> c_{d}" for d in DIMS))
    return rows.join(cells, same).select("doc_id", *DIMS, "n_tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with all their columns.
    Rows that share a doc_id are kept if one of them is."""
    return rows_with_id(docs, mixture(docs, id_col=id_col, **kw).where("kept").select("doc_id"), id_col, keep=True)
