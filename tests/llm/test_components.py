"""Components of repeated and chained edges, and the shuffles of a round."""

from __future__ import annotations

from tickloom.llm import components as Co


def test_a_round_compares_pairs_once(spark, monkeypatch):
    plans, cut = [], Co.cut
    monkeypatch.setattr(Co, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    chain = [(i, i + 1) for i in range(1, 30)]
    edges = spark.createDataFrame([*chain, *chain, (100, 50), (50, 100), (7, 7), (60, 50), (60, 100)], "a long, b long")
    found = {r.node: r.root for r in Co.components(edges, "a", "b").collect()}
    assert found == {i: 1 for i in range(2, 31)} | {60: 50, 100: 50}
    assert len(plans) > 1
    for text in plans[1:]:
        assert sum("hashpartitioning(hi#" in line and ", lo#" in line for line in text.splitlines()) == 1
