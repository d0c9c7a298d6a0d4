"""The pipeline against a plain version of its five stages."""

import hashlib
import random
import re

import brute

import corpus_pipeline
from furrow.llm import mixing, queries

INSULTS = ("zounderkite", "fopdoodle", "muckspout")


def plain_near(rows, size=5, least=80):
    """Rows whose id is the smallest of their component: five words, 0.8 or more."""
    sets = [brute.gram_set(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                top[root(i)] = root(j)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if smallest[root(i)] == r[0]]


def plain_sample(rows, marks):
    """Rows that the raked mixture draws; ``marks`` holds source and lang by id."""
    cell, tokens = {}, {}
    for d, t in rows:
        topic = next((n for n, p in mixing.TOPICS if re.search(p, t or "")), "prose")
        cell[d] = (*marks[d], topic)
        tokens[cell[d]] = tokens.get(cell[d], 0) + 1 + sum((t or "").count(c) for c in " \n\t")
    weight = {c: float(n) for c, n in tokens.items()}

    def share(values, k):
        out = {}
        for c, v in values.items():
            out[c[k]] = out.get(c[k], 0.0) + v
        return out

    goals = []
    for k in range(3):
        raw = {v: n ** mixing.TEMPER for v, n in share(tokens, k).items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(mixing.SWEEPS):
        for k in range(3):
            have = share(weight, k)
            weight = {c: w * goals[k][c[k]] / have[c[k]] for c, w in weight.items()}
    lo, hi, budget = 0.0, 1e9, mixing.KEEP * sum(tokens.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(n, weight[c] * mid) for c, n in tokens.items()) < budget else (lo, mid)
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2 ** 52
    return [(d, t) for d, t in rows if draw(d) < min(1.0, weight[cell[d]] * hi / tokens[cell[d]])]


def corpus():
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = [" ".join(some(60)) for _ in range(240)]
    texts += [" ".join(some(30) + list(INSULTS) * 4 + some(20)) for _ in range(120)]
    items = [" ".join(some(30)) for _ in range(4)]
    texts += [" ".join(some(20)) + " " + i + " " + " ".join(some(20)) for i in items]
    texts += [None, "", "a b c", "mail me at some.one@example.org now"]
    # one word changed within n words: n = 49 is five-word 0.80 and four-word 0.84, n = 48 is below 0.8
    for n in (49, 49, 49, 50, 48, 48, 90):
        w = [f"n{rng.random()}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w[:20] + ["other"] + w[21:])]
    texts += texts[:5]
    return texts, items


def test_pipeline_against_plain_stages(spark, tmp_dir):
    texts, items = corpus()
    rows = list(enumerate(texts, 1))
    marks = {d: ("s%d" % (d % 3), "en" if d % 4 else "de") for d, _ in rows}
    toxic = lambda t: any(w in (t or "") for w in INSULTS)
    spark.createDataFrame([(d, t, *marks[d]) for d, t in rows], "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(d, int(toxic(t))) for d, t in rows], "doc_id long, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    bench = list(enumerate(items))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")

    want = plain_near([(d, t) for d, t in rows if not toxic(t)])
    bad = {r[0] for r in brute.contamination(want, bench) if r[5]}
    want = plain_sample([(d, t) for d, t in want if d not in bad], marks)
    out = corpus_pipeline.run(spark, tmp_dir)
    got = sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(brute.token_rows(want, queries.tokenizer_path()))
