"""Places and overlaps of many matches, verdicts of secrets, clashing names, read tasks."""

import random
import re
import time

from pyspark.sql import functions as F

from furrow.llm import decontaminate, mixing, ngram_join, pii, secrets, spans, toxicity, warc
from furrow.llm.common import free_name, rows_with_id


def test_places_of_matches(spark):
    rng = random.Random(4)
    texts = ["", "b", "a", "aab", "é😀a", *["".join(rng.choices("abcé😀 ", k=rng.randrange(80))) for _ in range(300)], "ab" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for before in (False, True):
        out = df.select("i", spans.find(F.col("t"), "a+c?|😀", before=before).alias("s")).collect()
        for r in out:
            want, last, at = [], "", 0
            for m in re.finditer("a+c?|😀", texts[r.i]):
                want.append((m.start(), m.end(), m[0], *([last + texts[r.i][at:m.start()]] if before else [])))
                last, at = m[0], m.end()
            assert [tuple(x) for x in r.s] == want


def test_apart(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        cuts = sorted(rng.sample(range(60), 2 * rng.randrange(8)))
        mine = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        others = [(a, a + rng.randrange(1, 9)) for a in rng.choices(range(60), k=rng.randrange(6))]
        rows.append((i, mine, others))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i long, a {kind}, b {kind}").repartition(4)
    got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", spans.apart(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, mine, others in rows:
        assert got[i] == [s for s in mine if not any(s[0] < o[1] and o[0] < s[1] for o in others)], (mine, others)


def test_many_matches_in_one_text(spark):
    """Four times the matches take far less than sixteen times as long."""
    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"mail u{k}@ex{k}.org" for k in range(n)))], "doc_id long, text string")
        start = time.time()
        assert pii.scan(docs).first().n_email == n
        return time.time() - start
    seconds(10)
    assert seconds(20_000) < 8 * max(seconds(5_000), 2.0)


def test_verdicts(spark):
    key, copied, shared = "password=Ab3dEfGh1jKl", "password=Zx9yWv8uTs7r", "password=Qp6oNm5lKj4h"
    rows = [(1, key, "o1", "r1"), (2, key, "o1", "r2"), (3, key, None, None)]
    rows += [(10 + k, copied, f"o{k}", f"r{k}") for k in range(3)] + [(20 + k, shared, f"o{k}", "one") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    out = {r.doc_id: r for r in secrets.scan(docs, owner=F.col("source"), repository=F.col("repo")).collect()}
    verdict = lambda i: [(s.kind, s.n_owners, s.n_repositories, s.example) for s in out[i].judged]
    assert verdict(1) == verdict(3) == [("assign", 2, 3, False)]  # null is one owner and one repository
    assert verdict(10) == [("assign", 3, 3, True)] and out[10].n_example == 1
    assert verdict(20) == [("assign", 3, 1, False)]  # one repository that three share
    assert all(r.n_assign == 1 and len(r.base) == 1 for r in out.values())


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "s", "en", 7), (None, None, None, None, 7)],
                                 "doc_id long, text string, source string, lang string, __id long")
    docs = docs.withColumns({c: F.lit(1) for c in ("__bad", "__kept", "__stay", "__ID_")})
    assert free_name(docs, "__id") == "__id__"
    bench = spark.createDataFrame([("x", "one two three four five six seven eight nine ten")], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [None]
    assert ngram_join.one_of_each(docs).count() == 2
    assert mixing.sample(docs).columns == docs.columns
    ids = spark.createDataFrame([(None,), (None,)], "x long")
    assert rows_with_id(docs, ids, "doc_id", keep=True).count() == 1


def test_toxicity_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "x"), (3, "y"), (3, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert [r.held_out for r in out if r.doc_id is None] == [True] and all(0 <= r.score <= 1 for r in out)


def test_read_tasks_follow_records(spark, monkeypatch):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html")).repartition(4)
    index = warc.write_archives(pages)
    assert warc.read_records(index).rdd.getNumPartitions() == 4  # a piece per file
    monkeypatch.setattr(warc, "TASK_BYTES", 1000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 1000)
    back = warc.read_records(index)
    assert back.rdd.getNumPartitions() > 8 and back.select("page_id").distinct().count() == back.count() == 400
    assert warc.read_records(index.where("false")).count() == 0
