"""Personal data by bootstrapped contextual extraction (operator 10),
DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
phone numbers.  They are the seeds, each an instance as a whole, blanks
included.  Every identifier-like token outside of them (a digit in it,
``MIN_LENGTH`` characters or more) is an unseen instance.  The word before an
instance (before the token that it starts in), with the mark between them, is
its lexical pattern.  Pattern and instance form a
bipartite graph that Spark scores in rounds: a pattern scores the mean score of
its distinct instances (damped by ``DAMP``), an unseen instance one minus the
product of (1 - score) over its patterns; seeds keep 1.  Tokens that follow a
pattern of at least ``MIN_SEEDS`` seeds and a score of ``ACCEPT`` are added as
spans of kind ``ctx``; base spans always stay.

Scale.  One pass over the texts writes the findings (places, patterns, hashes,
no text).  The graph holds one row per distinct (pattern, instance), combined
in the tasks first; a common word is one row per instance it meets.  Scores
move by aggregates and plain joins that AQE can split, each round written to
the shared folder.  Only accepted patterns meet the findings again.

Patterns run in time linear in the text, places and overlaps of k matches in
k log k (see ``secrets``).

Defined cases: a null text is empty; rows that repeat are scanned each and
count once in the graph; without seeds no pattern is accepted; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import spans as S
from furrow.llm.common import plain, staged

KINDS = ("email", "ip", "card", "phone", "ctx")
MIN_LENGTH, MIN_SEEDS, DAMP, ACCEPT, ROUNDS = 5, 5, 2.0, 0.6, 3

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: a word, an optional mark, one blank, an identifier-like token
CONTEXT = (r"(?:\G|(?<![A-Za-z0-9À-ÿ]))[A-Za-zÀ-ÿ]++[:=#]?\x20"
           r"(?=[A-Za-z@._%+()/-]*+[0-9])[A-Za-z0-9+(][A-Za-z0-9@._%+()/-]*+")
TOKEN = r"\x20([^\x20]*)\z"
#: the word and mark before a base span, which may start within a token
LEAD = r"(?<![A-Za-z0-9À-ÿ])([A-Za-zÀ-ÿ]++[:=#]?)\x20(?:[A-Za-z0-9+(][A-Za-z0-9@._%+()/-]*+)?\z"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """13 to 19 digits whose check sum is 0."""
    rev = F.reverse(_digits(text))
    digit = lambda i: F.substring(rev, i, 1).cast("int")
    twice = lambda i: F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(i)).otherwise(digit(i)))
    return F.when(F.length(rev).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _small_parts(text: Column) -> Column:
    """All four numbers are at most 255, leading zeros or not."""
    ok = lambda p: F.when(F.length(p) <= 3, F.coalesce(p.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))
    return F.forall(F.split(text, r"\."), lambda p: ok(F.regexp_replace(p, r"\A0+", "")))


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans per kind, each with its text and what stands before it."""
    kind = lambda pattern, name, keep=None: S.tagged(S.find(text, pattern, before=True), name, KINDS.index(name), keep, ("before",))
    return {"email": kind(EMAIL, "email"),
            "ip": kind(IP, "ip", lambda s: _small_parts(s["text"])),
            "card": kind(CARD, "card", lambda s: _luhn(s["text"])),
            "phone": kind(PHONE, "phone", lambda s: F.length(_digits(s["text"])).between(9, 15))}


def findings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: uid, doc_id, base counts and spans, and ``near``: every base
    span that a word introduces (a seed) and every identifier-like token
    outside of base spans, with its place, pattern and hash."""
    src = docs.select(F.monotonically_increasing_id().alias("uid"), plain(id_col)[0].alias("doc_id"), F.coalesce(plain(text_col)[0].cast("string"), F.lit("")).alias("text"))
    src = src.select("uid", "doc_id", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], S.find(F.col("text"), CONTEXT).alias("near"))
    token = lambda s: F.regexp_extract(s["text"], TOKEN, 1)
    tokens = F.transform(F.filter("near", lambda s: F.length(token(s)) >= MIN_LENGTH), lambda s: F.struct(
        (s["end"] - F.length(token(s))).alias("start"), s["end"].alias("end"), F.regexp_replace(s["text"], r"\x20[^\x20]*\z", "").alias("pattern"), token(s).alias("text")))
    src = src.select("uid", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.concat(*KINDS[:4]).alias("base"), tokens.alias("near"))
    bare = lambda col: F.transform(col, lambda s: F.struct(*[s[c].alias(c) for c in ("k", "start", "end", "kind")]))
    instance = lambda start, end, pattern, text, seed: F.struct(
        start.alias("start"), end.alias("end"), F.lower(pattern).alias("pattern"), F.md5(text.cast("binary")).alias("instance"), F.lit(seed).alias("seed"))
    seeds = F.filter(F.transform("base", lambda s: instance(s["start"], s["end"], F.regexp_extract(s["before"], LEAD, 1), s["text"], True)), lambda s: s["pattern"] != "")
    unseen = F.transform(S.apart(F.col("near"), F.col("base")), lambda s: instance(s["start"], s["end"], s["pattern"], s["text"], False))
    return src.select("uid", "doc_id", *[f"n_{k}" for k in KINDS[:4]], bare(F.col("base")).alias("base"), F.concat(seeds, unseen).alias("near"))


def score_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, seeds, instances) after ``rounds`` over the graph."""
    edges = staged(found.select(F.explode("near").alias("n")).select("n.pattern", "n.instance", "n.seed")
                   .groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    seeds = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scored = edges.select("pattern", "instance", "seed", seeds.alias("value"))
    for k in range(rounds):
        patterns = staged(scored.groupBy("pattern").agg((F.sum("value") / (F.count(F.lit(1)) + DAMP)).alias("score"),
                                                        F.sum(F.col("seed").cast("long")).alias("seeds"), F.count(F.lit(1)).alias("instances")), f"patterns-{k}")
        if k + 1 == rounds:
            return patterns
        live = patterns.where("seeds > 0").select("pattern", "score")
        unseen = staged(edges.where("NOT seed").join(live, "pattern").groupBy("instance")
                        .agg((1.0 - F.exp(F.sum(F.log(F.lit(1.0) - F.col("score"))))).alias("reach")), f"instances-{k}")
        scored = edges.join(unseen, "instance", "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reach", F.lit(0.0))).alias("value"))
    raise ValueError("rounds must be positive")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS, accept: float = ACCEPT, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_ctx, base
    (spans of the base patterns), all (with the added ones), by kind, then start."""
    found = staged(findings(docs, text_col, id_col), "pii")
    good = staged(score_patterns(found, rounds).where((F.col("score") >= accept) & (F.col("seeds") >= min_seeds)).select("pattern"), "accepted")
    added = found.select("uid", F.explode("near").alias("n")).where("NOT n.seed").select("uid", "n.pattern", F.struct(
        F.lit(4).alias("k"), F.col("n.start").alias("start"), F.col("n.end").alias("end"), F.lit("ctx").alias("kind")).alias("s")) \
        .join(good, "pattern").groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("added"))
    out = found.join(added, "uid", "left")
    base = S.by_kind(F.col("base"))
    more = F.coalesce(F.col("added"), F.slice(base, 1, 0))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size(more).cast("long").alias("n_ctx"), base.alias("base"), F.concat(base, more).alias("all"))
