"""Raking is many small plans, not a few that double with every marginal."""

from furrow.llm import mixing


def test_raking_plans_stay_small(spark, monkeypatch):
    plans, real = [], mixing.staged

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(mixing, "staged", noted)
    cells = spark.createDataFrame([("a", "en", "prose", 10), ("a", "de", None, 30), ("b", "en", "prose", 60), (None, "de", "markup", 5)],
                                  "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, sweeps=3)
    assert out.columns == [*mixing.DIMS, "tokens", "weight"] and out.count() == 4
    raked = [p for name, p in plans if name.startswith("rake-")]
    assert len(raked) == 9
    for p in raked:
        assert p.count("Join ") == 1 and p.count("Aggregate ") == 1
