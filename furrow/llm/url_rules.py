"""URL filter: given host/path rules, then mined association rules (operator 4).

A given rule (verdict, host, path) fits its host and all subdomains if the
url's path starts with the rule's path; the longest fitting rule wins.  URLs
that no rule fits get the method's verdict: Spark's FP-growth mines frequent
combinations of URL tokens among labelled pages, rules "tokens => bad" are
pruned by support, confidence and by simpler rules that are as sure, and an
inverted index (each rule under its rarest token) finds the rules a URL fits.

Scale.  Given rules are looked up in a map by host suffix, without a shuffle.
FP-growth is Spark's own, distributed by item.  The number of mined rules is
bounded by the support, which is a share of the labelled pages; whether their
index is broadcast is left to Spark's size check.  A URL meets only the rules
posted under its tokens, and only pages with a match enter the last join.

Defined cases: a null url, or one without "://", has an empty host and path, no
tokens, and is allowed; an empty host fits no rule; pages that repeat are
judged each; without labels or frequent combinations every other URL is
allowed; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import plain, staged

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
BAD = "bad"

_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), *_ASCII)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels (h:), path pieces (p:), the file ending (x:)
    and query keys (q:).  Numbers become '#'."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A[^#]*?://[^?#]*\?([^#]*)", 1)
    number = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    tagged = lambda arr, tag: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(tag), number(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})\z", 1)
    pieces = F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,8}\z", ""), "/")
    return F.array_distinct(F.concat(tagged(F.split(host, r"\."), "h:"), tagged(pieces, "p:"), tagged(F.array(ending), "x:"),
                                     tagged(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"\A([^=]*)", 1)), "q:")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h.lower(), []).append((verdict, h.lower() + p, p))
    one = lambda v, r, p: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(p).alias("path"))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[one(*r) for r in rs]))])
    parts = F.split(host, r"\.")
    suffixes = F.transform(parts, lambda _, i: F.concat_ws(".", F.slice(parts, i + 1, F.size(parts))))
    fit = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())),
                   lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, support) for "tokens => bad".  ``pages``
    has id and tokens, ``labels`` has id and bad (boolean)."""
    spark = pages.sparkSession
    empty = "tokens array<string>, confidence double, support double"
    baskets = staged(pages.join(labels.where("bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad")), "id")
                     .select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
                     .where(F.size("items") > 0), "baskets")
    if baskets.isEmpty():
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = staged(model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
                   .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    # a rule goes if one of its own subsets is as sure: subsets are looked up by
    # leaving out one token at a time, which is enough as the simpler one is judged alike
    shorter = rules.select("tokens", F.explode("tokens").alias("t")).select("tokens", F.array_remove("tokens", F.col("t")).alias("part"))
    simple = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    worse = shorter.join(simple, "part").join(rules.select("tokens", "confidence"), "tokens").where("sure >= confidence").select("tokens").distinct()
    return rules.join(worse, "tokens", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ids of ``pages`` (id, tokens) that hold all tokens of a rule."""
    count = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.withColumn("rule_id", F.monotonically_increasing_id()).select("rule_id", "tokens", F.explode("tokens").alias("token")) \
        .join(count, "token").groupBy("rule_id").agg(F.first("tokens").alias("need"), F.min(F.struct("n", "token"))["token"].alias("token"))
    index = staged(posted.select("token", "need"), "url-index")
    return pages.select("id", "tokens", F.explode("tokens").alias("token")).join(index, "token") \
        .where(F.size(F.array_except("need", "tokens")) == 0).select("id").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per row of ``pages``: page_id, url, host, path, rule, verdict, mined
    (a mined rule fits).  ``labels`` has id (a page_id) and bad (boolean)."""
    url = plain(url_col)[0].cast("string")
    seen = staged(pages.select(F.monotonically_increasing_id().alias("id"), plain(id_col)[0].alias("page_id"), url.alias("url")), "urls")
    seen = seen.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "tokens": url_tokens(F.col("url"))})
    mined = mine(seen.select(F.col("page_id").alias("id"), "tokens"), labels, min_support, min_confidence)
    bad = matched(seen.select("id", "tokens"), mined).withColumn("mined", F.lit(True))
    out = seen.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).join(bad, "id", "left")
    flag = F.coalesce(F.col("mined"), F.lit(False))
    return out.select("page_id", "url", "host", "path", F.col("fit")["rule"].alias("rule"),
                      F.coalesce(F.col("fit")["verdict"], F.when(flag, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), flag.alias("mined"))
