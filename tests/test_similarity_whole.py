import numpy as np

from test_graphs import union_find
from tracemill.operators import similarity as S
from tracemill.operators.components import components


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def unit_rows(n, size, seed):
    x = np.random.default_rng(seed).standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_mutual_neighbours_of_queries_are_those_among_all_rows(spark):
    x = unit_rows(120, 6, 1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    first, ranked = s.argmax(axis=1), np.sort(s, axis=1)
    lead = ranked[:, -1] - ranked[:, -2] >= 0.01
    want = {(i, int(j)) for i, j in enumerate(first) if i < j and first[j] == i and lead[i] and lead[j] and (i % 10 == 0 or j % 10 == 0)}
    v = vectors(spark, enumerate(x))
    q = v.where("vec_id % 10 = 0")
    got = {(r["left"], r["right"]) for r in S.mutual_among_all(v, q, 0.01).collect()}
    assert got == want and any(j % 10 for _, j in want)
    assert got != {(r["left"], r["right"]) for r in S.mutual_neighbours(S.top_k_cosine(q, q, 2), 0.01).collect()}


def test_threshold_components_have_no_cap_on_partners_and_every_row(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    x = unit_rows(90, 5, 2)
    x[:8] = x[0] + np.random.default_rng(3).standard_normal((8, 5)) / 50  # each has more than three partners
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(str(i), str(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i != j]
    found = union_find(links)
    want = {str(i): found.get(str(i), str(i)) for i in range(90)}
    v = vectors(spark, enumerate(x))
    got = {r["id"]: r["label"] for r in components(S.threshold_links(v, 0.9), v.selectExpr("cast(vec_id as string) as id")).collect()}
    assert got == want and len(set(want.values())) > 5
    capped = S.top_k_cosine(v, v.where("vec_id % 50 = 0"), 3).where("score >= 0.9").selectExpr("query_id as u", "id as v")
    assert {r["id"]: r["label"] for r in components(capped).collect()} != want
