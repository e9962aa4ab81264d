import random

import pytest

from tracemill.operators import blocking as B
from tracemill.operators.components import components


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [3, 4])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(90)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [("hub", f"n{i}") for i in range(20)] + [(None, "n1"), ("n1", None)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == union_find(edges)


def test_components_of_nothing_and_of_lone_vertices(spark):
    none = spark.createDataFrame([], "u string, v string")
    assert components(none).count() == 0
    alone = spark.createDataFrame([("x",), ("y",)], "id string")
    assert sorted(map(tuple, components(none, alone).collect())) == [("x", "x"), ("y", "y")]


def greedy(buckets, budget):
    used, out = {}, set()
    for value, members in sorted(buckets.items(), key=lambda b: (len(b[1]), min(b[1]), b[0])):
        ms = sorted(members)
        for i, a in enumerate(ms):
            for b in ms[i + 1 :]:
                if (a, b) not in out and used.get(a, 0) < budget and used.get(b, 0) < budget:
                    out.add((a, b))
                    used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return out


@pytest.mark.parametrize("budget", [2, 5, 100])
def test_bounded_pairs_are_the_greedy_ones(spark, budget):
    rng = random.Random(budget)
    buckets = {}
    for i in range(60):
        for v in rng.sample(range(25), 3):
            buckets.setdefault(f"v{v:02}", set()).add(f"r{i:02}")
    rows = [(m, v) for v, ms in buckets.items() for m in ms]
    df = spark.createDataFrame(rows, "id string, value string").selectExpr("'' as block", "id", "value")
    kept = {v: ms for v, ms in buckets.items() if 1 < len(ms) <= 8}
    got = {(r["left"], r["right"]) for r in B.bounded_pairs(df, 8, budget).collect()}
    assert got == greedy(kept, budget)


def test_star_edges_skip_single_and_oversized_buckets(spark):
    df = spark.createDataFrame([("", "a", "x"), ("", "b", "x"), ("", "c", "x"), ("", "a", "y"), ("", "a", "z"), ("", "b", "z")], "block string, id string, value string")
    assert sorted(map(tuple, B.star_edges(df, 2).collect())) == [("a", "b")]
    assert sorted(map(tuple, B.star_edges(df).collect())) == [("a", "b"), ("a", "c")]
