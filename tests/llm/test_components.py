import random

import pytest

from tracemill.llm.components import connected_components, match_links


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["star", "path", "random", "mixed", "giant with tail"])
def test_shapes(spark, kind):
    rng = random.Random(5)
    star = [("hub", f"s{i:03}") for i in range(60)]
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)]
    rand = [(f"n{rng.randrange(80)}", f"m{rng.randrange(80)}") for _ in range(60)]
    edges = {"star": star, "path": path, "random": rand, "mixed": star + path + rand + [("n1", "n1"), (None, "x"), ("y", None)], "giant with tail": star + path + [("s005", "p000"), ("s006", "aaa")]}[kind]
    got = [tuple(r) for r in connected_components(spark.createDataFrame(edges + edges[:5], "u string, v string").selectExpr("v", "u", "1 as id", "2 as label")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == union_find(edges)


def test_none(spark):
    assert connected_components(spark.createDataFrame([("a", "a"), (None, "b")], "u string, v string")).count() == 0


def test_links(spark):
    p = spark.createDataFrame([(" a ", "b", 5.0, []), ("a", "c", 5.0, ["x"]), ("a", "d", 4.1, None), ("e", "f", 4.2, None), (" ", "g", 9.0, None)], "earlier_id string, later_id string, score double, conflicts array<string>")
    d = spark.createDataFrame([("h", " i", "accept"), ("h", "j", "reject"), ("k", None, "accept")], "request_id string, predecessor_id string, disposition string")
    got = sorted(map(tuple, connected_components(match_links(p, d)).collect()))
    assert got == [("a", "a"), ("b", "a"), ("e", "e"), ("f", "e"), ("h", "h"), ("i", "h")]
