"""Conversation log jobs (ops 6.7, 6.8), re-aimed from per-request helpers.

Turns table: ``(conv_id, turn, role, text)``.  The per-conversation top-k
is exact two-phase: rows are first ranked within ``(conv_id, bucket)``
where the bucket is a hash of the turn, so a huge conversation is spread
over many tasks; only ``k`` candidates per bucket reach the final
per-conversation ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import after_marker, is_retry, strip_ws
from furrow.operators.fill import carry_forward_before

# History depth shown to the assistant, and its first line.
HISTORY_TURNS = 6
HISTORY_HEADER = "Conversation history from this same session:"


def top_k_per_group(df: DataFrame, keys: list[str], order: list, k: int, buckets: int = 64,
                    bucket_of=None) -> DataFrame:
    """Exact top-k rows per key in two phases (skew-safe)."""
    b = bucket_of if bucket_of is not None else F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets))
    staged = df.withColumn("__b", b)
    w1 = Window.partitionBy(*keys, "__b").orderBy(*order)
    cand = staged.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k).drop("__r", "__b")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return cand.withColumn("__r", F.row_number().over(w2)).where(F.col("__r") <= k).drop("__r")


def last_turns(turns: DataFrame, k: int = HISTORY_TURNS, skip_current: bool = True, chunk_turns: int = 256) -> DataFrame:
    """Last ``k`` visible turns of each conversation rendered in order (op 6.7).

    A user row opens an invocation, and the assistant rows up to the next user
    row belong to it (those before the first user row are one of their own).
    An invocation is one turn of at most one user and one assistant text; the
    last non-blank text of each wins.  User text is the body after the
    ``USER MESSAGE:`` marker.  A turn without text is not visible.  The
    invocation that the last user row opened is the current one and left out
    (``skip_current``).  Output: conv_id, n_turns, history (a header line, then
    ``Turn i role: text`` lines, oldest first); conversations without a visible
    turn have no row.
    """
    user = F.col("role") == "user"
    rows = turns.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", "role", F.when(user, F.lit(0)).otherwise(F.lit(1)).alias("__side"),
        F.when(user, after_marker("text")).otherwise(strip_ws("text")).alias("body"), F.when(user, F.col("turn")).alias("__open"))
    rows = carry_forward_before(rows, ["conv_id"], ["turn", "__side"], "__open", "__prev", chunk=F.floor(F.col("turn") / chunk_turns))
    rows = rows.withColumn("inv", F.coalesce("__open", "__prev", F.lit(-1).cast(turns.schema["turn"].dataType)))

    def last_text(role: str):
        return F.max(F.when((F.col("role") == role) & (F.col("body") != ""), F.struct("turn", "body")))

    paired = rows.groupBy("conv_id", "inv").agg(last_text("user")["body"].alias("user"), last_text("assistant")["body"].alias("assistant"))
    if skip_current:
        current = rows.groupBy("conv_id").agg(F.max("__open").alias("__current")).withColumnRenamed("conv_id", "__conv")
        paired = paired.join(current, F.col("conv_id").eqNullSafe(F.col("__conv"))).where("__current IS NULL OR inv <> __current").drop("__conv", "__current")
    visible = paired.where(F.col("user").isNotNull() | F.col("assistant").isNotNull())
    top = top_k_per_group(visible, ["conv_id"], [F.col("inv").desc()], k, bucket_of=F.pmod(F.xxhash64("inv"), F.lit(64)))
    # at most k turns per conversation remain: a bounded collect
    agg = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("inv", "user", "assistant"))).alias("t"))

    def line(i, role: str, text):
        return F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(f" {role}: "), text)

    lines = F.transform("t", lambda x, i: F.concat_ws("\n", line(i, "user", x["user"]), line(i, "assistant", x["assistant"])))
    return agg.select("conv_id", F.size("t").alias("n_turns"), F.concat_ws("\n", F.lit(HISTORY_HEADER), lines).alias("history"))


def previous_requests(turns: DataFrame, chunk_turns: int = 256) -> DataFrame:
    """For every user message: is it a retry, and the latest earlier user
    message that is not a retry (op 6.8).  Output: conv_id, turn, retry,
    previous_request (null when none)."""
    users = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", "text", is_retry("text").alias("retry"))
    src = users.withColumn("__cand", F.when(~F.col("retry") & (strip_ws("text") != ""), strip_ws("text")))
    res = carry_forward_before(src, ["conv_id"], ["turn"], "__cand", "previous_request",
                               chunk=F.floor(F.col("turn") / chunk_turns))
    return res.select("conv_id", "turn", "retry", "previous_request")


def resolve_retries(turns: DataFrame, chunk_turns: int = 256) -> DataFrame:
    """Only the retry messages, with the request they repeat."""
    return previous_requests(turns, chunk_turns).where(F.col("retry")).drop("retry")
