import random

import pytest

from shelfspark.llm.components import components


@pytest.mark.parametrize("shape", ["random", "path", "star", "two", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 1), (5, 5), (2, None)],
        "path": [(k, k + 1) for k in range(64)],
        "star": [(500, k) for k in range(100)],
        "two": [(1, 2), (2, 1), (3, 4)],
        "empty": [],
    }[shape]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    for a, b in real:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    expected = {n: find(n) for e in real for n in e}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
