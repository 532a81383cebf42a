import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        own = min(v for i, v in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in good if i != q)[:k]
        out |= {(q, n, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(found, 1)}
    return out


def vectors(n, width, seed):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.2) for _ in range(width)]) for k in range(n)]


def result(spark, rows):
    return {tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("shard", [40, 5000])
def test_against_all(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rows = vectors(300, 9, 1)
    rows += [(1000 + k, rows[7][1]) for k in range(40)] + [(50, rows[3][1])]  # ties, and an id that is there twice
    rows += [(None, rows[0][1]), (2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")] * 9), (2004, [0.5, 0.5]), (2050, []), (2100, [1e12] * 9), (2101, [1e12] * 9)]
    assert result(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert result(spark, vectors(3, 4, 2)) == brute(vectors(3, 4, 2))
    assert result(spark, vectors(1, 4, 2)) == set()
    assert topk.top_k(frame(spark, vectors(1, 2, 1)).where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_boxes_and_bounds():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 60, (2000, 6)))
    tree = topk.Tree(np.arange(2000), rows, 50)
    queries = np.floor(rng.normal(0, 60, (20, 6)))
    bounds = tree.bounds(queries)
    for n, leaf in enumerate(tree.leaves):
        if leaf:
            assert (leaf[1].min(axis=0) == tree.lo[n]).all() and (leaf[1].max(axis=0) == tree.hi[n]).all()
            assert ((leaf[1] @ queries.T).max(axis=0) <= bounds[:, n] + 1e-9).all()
    for q, bound in zip(queries, bounds, strict=True):
        got = sorted(tree.search(q, -1, bound, 5, -math.inf), key=lambda x: (-x[0], x[1]))
        best = sorted(zip((rows @ q).tolist(), range(2000), strict=True), key=lambda x: (-x[0], x[1]))[:5]
        assert got == [(int(s), i) for s, i in best]
        assert sorted(tree.search(q, -1, bound, 5, got[-1][0])) == sorted(got)
