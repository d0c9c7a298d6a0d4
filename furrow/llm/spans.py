"""Regex matches with their places, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


def _running(values: Column, step, finish) -> Column:
    """``finish`` of the running result of ``step`` over an array of numbers: each
    round combines every number with the one 1, 2, 4, ... places before, so the
    cost is that of a sort, not of the square."""
    rounds = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(rounds, values, lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, step(v, F.get(acc, i - d))).otherwise(v)), finish)


def find(text: Column, pattern: str, before: bool = False) -> Column:
    """Leftmost non-overlapping matches as struct(start, end, text), in code
    points, the end exclusive.  What stands between the matches gives their
    places; it is cut only if there is a match.  With ``before`` each match
    brings the last match and what follows it up to its own start: all of them
    together are at most twice the text."""
    kind = SPAN.replace("text:string", "text:string,before:string") if before else SPAN
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pair = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("m"),
                        *([F.slice(F.concat(F.array(F.lit("")), found), F.lit(1), F.size(found)).alias("last")] if before else []))

    def placed(ends):
        return F.transform(pair, lambda x, i: F.struct((F.get(ends, i) - F.length(x["m"])).alias("start"), F.get(ends, i).alias("end"), x["m"].alias("text"),
                                                       *([F.concat(x["last"], x["b"]).alias("before")] if before else [])))

    lengths = F.transform(pair, lambda x: F.length(x["b"]) + F.length(x["m"]))
    return F.when(F.size(found) > 0, _running(lengths, lambda a, b: a + b, placed)).otherwise(F.array().cast(kind))


def apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of ``others``, by start: both are sorted together,
    and a span meets another if the greatest end of those that start before its
    own end lies beyond its start."""
    mark = lambda at, kind, reach, s: F.struct(at.alias("at"), F.lit(kind).alias("other"), reach.alias("reach"), s.alias("s"))
    none = F.when(F.lit(False), F.element_at(spans, 1))
    events = F.array_sort(F.concat(F.transform(spans, lambda s: mark(s["end"], 0, F.lit(-1), s)),
                                   F.transform(others, lambda o: mark(o["start"], 1, o["end"], none))))

    def clear(reach):
        free = F.filter(events, lambda e, i: (e["other"] == 0) & (F.get(reach, i) <= e["s"]["start"]))
        return F.transform(free, lambda e: e["s"])

    reach = F.transform(events, lambda e: e["reach"])
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(_running(reach, lambda a, b: F.greatest(a, b), clear))


def tagged(spans: Column, kind: str, order: int, keep=None, more: tuple[str, ...] = ()) -> Column:
    """Spans that pass ``keep``, with their kind, its place in the listing and
    the fields of ``more``."""
    spans = spans if keep is None else F.filter(spans, keep)
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"), *[s[c].alias(c) for c in more]))


def line(spans: Column) -> Column:
    """kind:start:end, comma-joined in the given order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: s)


def by_kind(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
