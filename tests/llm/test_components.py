import random

import pytest

from lodestream.llm import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("per_part", [100_000, 7])
def test_against_union_find(spark, monkeypatch, per_part):
    monkeypatch.setattr(components, "ROWS_PER_PART", per_part)
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(-5, i) for i in range(2000, 2030)]
    edges = chain + star + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (1001, 1000)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {x: c for x, c in brute([e for e in edges if e[0] != e[1]]).items()}
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_no_links(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
