"""Base spans of all four kinds seed the bootstrapping, blanks or not."""

import brute
import pytest
from pyspark.sql import functions as F

from furrow.llm import pii


def cards(n):
    out = []
    for i in range(n):
        digits = f"41111111111{i:04d}"
        digits += next(c for c in "0123456789" if brute.luhn(digits + c))
        out.append(" ".join(digits[k:k + 4] for k in range(0, 16, 4)))
    return out


@pytest.mark.parametrize("word,seeds", [
    ("ring", [f"+49 30 12345{i:02d}" for i in range(12)]),
    ("ring:", [f"+1 (017) 555-77{i:02d}" for i in range(12)]),
    ("ring", [f"(+49 30 12345{i:02d})" for i in range(12)]),
    ("pay#", cards(12)),
    ("mail:", [f"{c}.user@example.com" for c in "abcdefghijkl"]),
    ("host=", [f"1.2.3.{i}" for i in range(12)])])
def test_pii_kinds_are_seeds(spark, word, seeds):
    docs = [(i, f"some words {word} {s} and more") for i, s in enumerate(seeds)] + [(50, f"please {word} ZK-99817 now, the 12345 case")]
    out = {r.doc_id: r for r in pii.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    at = len(f"please {word} ")
    assert [(s.kind, s.start, s.end) for s in out[50]["all"]] == [("ctx", at, at + 8)]
    assert all(out[i].n_ctx == 0 and len(out[i]["base"]) == 1 for i in range(12))


def test_pii_word_before_a_span(spark):
    rows = [(1, "Call: +49 30 1234567 or x@y.org"), (2, "of +49 30 1234567"), (3, "a@b.de c@d.de"), (4, "7up 1.2.3.4 (1.2.3.4"), (5, "1.2.3.4"), (6, "é" * 3000 + " 1.2.3.4"),
            (7, "id 300.1.2.3"), (8, "tel. +49 30 1234567")]
    found = pii.findings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("near").alias("n")).select("doc_id", "n.*")
    assert sorted((r.doc_id, r.pattern, r.start, r.end, r.seed) for r in found.collect()) == [
        (1, "call:", 6, 20, True), (1, "or", 24, 31, True), (2, "of", 3, 17, True), (3, "de", 7, 13, True), (6, "é" * 3000, 3001, 3008, True), (7, "id", 3, 12, False)]
    hashes = {r.doc_id: r.instance for r in found.where("doc_id IN (1, 2) AND pattern <> 'or'").collect()}
    assert hashes[1] == hashes[2]
