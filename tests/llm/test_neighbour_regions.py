"""Recall of queries in a sparse region beside a dense one, and tables with hardly more rows than an answer."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def test_sparse_queries_are_answered_in_full(spark):
    from tendon.llm import neighbours
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    x[:3880] = rng.normal(size=32) + 0.05 * x[:3880]
    x /= np.sqrt((x * x).sum(1))[:, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    asked = [*range(0, 3880, 40), *range(3880, 4000, 4)]
    got = defaultdict(set)
    for r in neighbours.nearest(df, df.where(df.vec_id.isin(asked))).collect():
        got[r.query_id].add(r.vec_id)
    s = x.astype(float) @ x[asked].astype(float).T
    recall = {}
    for i, a in enumerate(asked):
        best = [int(b) for b in np.argsort(-s[:, i], kind="stable") if b != a][:20]
        assert len(got[a]) == 20
        recall[a] = len(got[a] & set(best)) / 20
    dense, sparse = (np.mean([r for a, r in recall.items() if (a < 3880) == d]) for d in (True, False))
    print(f"recall dense {dense:.3f} sparse {sparse:.3f}")
    assert dense >= 0.9 and sparse >= 0.9


def test_small_tables_give_all(spark):
    from tendon.llm import neighbours
    x = np.random.default_rng(4).normal(size=(21, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, df).count() == 21 * 20
