"""Rule mining of operator 4 against counting every token set."""

import math
import random
from itertools import combinations

from furrow.llm import url_rules


def plain_rules(baskets, min_support, min_confidence):
    """{tokens: (confidence, support)} of the rules "tokens => bad" that no rule of one token less equals."""
    sets = {c for tokens, _ in baskets for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)}
    n, least = len(baskets), math.ceil(min_support * len(baskets))
    sure = {}
    for c in sets:
        held = [bad for tokens, bad in baskets if tokens.issuperset(c)]
        if sum(held) >= least:
            sure[c] = (sum(held) / len(held), sum(held) / n)
    good = {c: v for c, v in sure.items() if v[0] >= min_confidence}
    return {c: v for c, v in good.items() if not any(good.get(p, (0,))[0] >= v[0] for p in combinations(c, len(c) - 1))}


def test_mined_rules_equal_counting(spark):
    rng = random.Random(3)
    baskets = []
    for _ in range(300):
        tokens = {t for t in "abcdef" if rng.random() < 0.4} or {"a"}
        baskets.append((tokens, rng.random() < (0.9 if {"a", "b"} <= tokens else 0.6 if "c" in tokens else 0.1)))
    pages = spark.createDataFrame([(i, sorted(t)) for i, (t, _) in enumerate(baskets)], "id long, tokens array<string>")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(baskets)] + [(900, True), (901, None)], "id long, bad boolean")
    want = plain_rules(baskets, 0.03, 0.6)
    got = {tuple(r.tokens): (r.confidence, r.support) for r in url_rules.mine(pages, labels, 0.03, 0.6).collect()}
    assert got.keys() == want.keys() and ("a", "b") in got
    assert all(abs(got[c][k] - want[c][k]) < 1e-9 for c in want for k in (0, 1))
