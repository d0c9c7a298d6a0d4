"""Components by hooks and doubling: few staged writes whatever the order of ids."""

import random

import pytest

from furrow.llm import common, ngram_join


def _labels(spark, edges):
    return dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "u long, v long")).select("node", "label").collect())


@pytest.mark.parametrize("n, most", [(64, 12), (1024, 14)])
def test_ascending_paths_take_few_writes(spark, monkeypatch, n, most):
    writes, real = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: writes.append(name) or real(df, name))
    assert _labels(spark, [(i, i + 1) for i in range(n - 1)]) == dict.fromkeys(range(n), 0)
    assert len(writes) <= most, writes


def test_graphs_of_any_shape(spark):
    rng = random.Random(8)
    ids = rng.sample(range(10_000), 300)
    edges = list(zip(ids[:60], ids[1:60])) + [(ids[70], x) for x in ids[71:120]] + [(rng.choice(ids[130:]), rng.choice(ids[130:])) for _ in range(120)]
    edges += [edges[0], edges[0][::-1], (5, 5)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            top[b] = a
    assert _labels(spark, edges) == {x: root(x) for x in top}
    assert _labels(spark, [(1, 1)]) == {}


def test_chain_of_revisions_is_one_component(spark):
    rng = random.Random(1)
    words = ["w%d" % rng.randrange(10**6) for _ in range(400)]
    texts = [" ".join(words[20 * k:20 * k + 260]) for k in range(8)]  # each resembles only its neighbours
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = ngram_join.similar_documents(docs).collect()
    assert {r.component_id for r in out} == {100}
