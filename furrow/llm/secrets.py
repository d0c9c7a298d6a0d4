"""Secret scan with corpus-wide ownership (operator 6), DataFrame functions only.

Candidates are the base patterns (assignments, access keys, long hex) and, in
addition, long tokens that mix letters and digits.  Each candidate value is
hashed; per hash the distinct repositories and owners that hold it are counted
over the whole corpus.  A value seen with ``EXAMPLE_OWNERS`` owners or more, in
``EXAMPLE_REPOSITORIES`` repositories or more (if repositories are given), is a
widely copied example; any other looks live: it belongs to its owners, or to one
repository that they share.  Every candidate, base ones too, gets this verdict.
Long mixed tokens that look live are added as spans of kind ``live``; base spans
always stay.

Scale.  One pass over the texts writes the findings (places and hashes, no
text) to the shared folder.  Counting is two aggregates that combine in the
tasks first: (hash, owner, repository), then hash.  The verdicts are joined back
to all candidates by hash, and AQE can split a hot one, as both sides are plain
exchanges.  What is grouped again is one document's findings.

Patterns run in time that is linear in the text: runs are possessive and may
only start where a run starts (or where the last match ended), which gives the
same matches as the plain patterns.  Places and overlaps of a text with k matches
cost k log k (``spans``).

Defined cases: a null text is empty; a null owner or repository counts as one
of its own; rows that repeat are scanned each, and count once per owner and
repository; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import spans as S
from furrow.llm.common import plain, staged

KINDS = ("assign", "access", "hex", "live")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 2
MIN_DISTINCT = 10

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i)\A(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)\z"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans per kind."""
    value = lambda s: F.regexp_extract(s["text"], ASSIGN_VALUE, 1)
    return {"assign": S.tagged(S.find(text, ASSIGN), "assign", 0, lambda s: F.length(value(s)) >= 8),
            "access": S.tagged(S.find(text, ACCESS), "access", 1, lambda s: F.length(s["text"]) >= 16),
            "hex": S.tagged(S.find(text, HEX), "hex", 2)}


def findings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Per row: uid, doc_id, owner, repository, base counts and spans, and
    ``values``: every candidate with its place and hash."""
    none = F.lit(None).cast("string")
    src = docs.select(F.monotonically_increasing_id().alias("uid"), plain(id_col)[0].alias("doc_id"),
                      (none if owner is None else owner).cast("string").alias("owner"), (none if repository is None else repository).cast("string").alias("repository"),
                      F.coalesce(plain(text_col)[0].cast("string"), F.lit("")).alias("text"))
    src = src.select("uid", "doc_id", "owner", "repository", *[c.alias(k) for k, c in base_spans(F.col("text")).items()],
                     S.tagged(S.find(F.col("text"), MIXED), "live", 3, lambda s: F.size(F.array_distinct(F.split(s["text"], ""))) > MIN_DISTINCT).alias("live"))
    src = src.select("uid", "doc_id", "owner", "repository", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                     F.concat("assign", "access", "hex").alias("base"), "live").withColumn("live", S.apart(F.col("live"), F.col("base")))
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["text"], ASSIGN_VALUE, 1)).otherwise(s["text"])
    strip = lambda col: F.transform(col, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.md5(value(s).cast("binary")).alias("hash")))
    return src.select("uid", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", strip(F.col("base")).alias("base"), strip(F.col("live")).alias("live"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_rows) over the whole corpus; a
    repository that several owners share is one."""
    one = found.select("owner", "repository", F.explode(F.concat("base", "live")["hash"]).alias("hash"))
    per = one.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    # a struct around each, so that null counts as one
    return per.groupBy("hash").agg(F.count_distinct(F.struct("owner")).alias("n_owners"), F.count_distinct(F.struct("repository")).alias("n_repositories"), F.sum("n").alias("n_rows"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner: Column | None = None, repository: Column | None = None,
         example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_live (added
    spans), n_example (candidates whose value is widely copied), base (spans of
    the base patterns), all (with the added ones), judged (every candidate, base
    ones too, with n_owners, n_repositories and example, its verdict), each
    sorted by start."""
    found = staged(findings(docs, text_col, id_col, owner, repository), "secrets")
    spread = F.col("n_owners") >= example_owners
    if repository is not None:
        spread = spread & (F.col("n_repositories") >= example_repositories)
    owned = staged(ownership(found).select("hash", "n_owners", "n_repositories", spread.alias("example")), "ownership")
    each = found.select("uid", F.explode(F.concat("base", "live")).alias("s")).select("uid", "s", F.col("s.hash").alias("hash"))
    verdict = F.struct("s.start", "s.k", "s.end", "s.kind", "n_owners", "n_repositories", "example")
    per = each.join(owned, "hash").groupBy("uid").agg(F.sort_array(F.collect_list(verdict)).alias("judged"))
    out = found.join(per, "uid", "left").withColumn("judged", F.coalesce("judged", F.array().cast("array<struct<start:int,k:int,end:int,kind:string,n_owners:bigint,n_repositories:bigint,example:boolean>>")))
    place = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "k", "end", "kind")])
    base = S.by_start(F.col("base"))
    added = F.transform(F.filter("judged", lambda s: (s["kind"] == "live") & ~s["example"]), place)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.size(added).cast("long").alias("n_live"), F.size(F.filter("judged", lambda s: s["example"])).cast("long").alias("n_example"),
                      base.alias("base"), F.array_sort(F.concat(base, added)).alias("all"), "judged")
