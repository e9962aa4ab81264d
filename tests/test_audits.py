import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.functions.digests import prefix_digests
from tracemill.operators import audits as A
from tracemill.operators import documents as D
from tracemill.operators import encoders as C
from tracemill.operators import evaluation as E
from tracemill.operators import linkage as L
from tracemill.operators import workflows as W
from tracemill.operators.ordered import numbered, running_max
from tracemill.operators.requests import canonical_requests


def test_exposure_and_handles_of_nothing_and_of_few(spark):
    truth = spark.createDataFrame([("r1", "a", "w1"), ("r2", "a", "w1"), ("r3", "b", None), ("r4", "c", "w2")], "request_id string, label string, workflow string")
    anchors = spark.createDataFrame([("r1", "a"), ("r1", "z"), ("r3", "z"), ("x", "a")], "request_id string, anchor string")
    got = A.exposure(truth, anchors).head()
    assert tuple(got) == (4, 2, 3, 0.5, 0.25, 0.25, 0.25, 0.5, 0.0, 1 / 3)
    assert tuple(A.exposure(truth.where("false"), anchors).head())[:3] == (0, 0, 0)
    h = A.handle_audit(truth, anchors).head()
    assert (h["requests"], h["coverage"], h["handles"], h["recurrent"], h["ambiguous"], h["median_requests"]) == (4, 0.5, 2, 0.5, 0.5, 1.5)
    assert A.handle_audit(truth, anchors.where("false")).head()["handles"] == 0


def test_splits_take_the_share_of_each_stratum(spark):
    rows = spark.range(103).select(F.format_string("k%03d", "id").alias("key"), (F.col("id") % 2 == 0).alias("stratum"))
    got = A.stratified_split(rows, "key", "stratum", 0.25)
    assert {r["stratum"]: r["n"] for r in got.where("held_out").groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {True: 13, False: 13}
    assert got.count() == 103 and A.stratified_split(rows.where("false"), "key", "stratum", 0.5).count() == 0
    assert 0 < A.interval_split(rows, "key", 0.3).where("held_out").count() < 103


def test_controls_have_the_sizes_of_truth(spark):
    ids = spark.range(30).select(F.format_string("r%02d", "id").alias("request_id"))
    truth = ids.select(F.explode(F.array(*map(F.lit, L.LEVELS))).alias("level"), "request_id", F.when(F.col("request_id") < "r12", "big").when(F.col("request_id") < "r20", "mid").otherwise(F.col("request_id")).alias("label")).where("request_id < 'r25'")
    got = L.oracle_size_control(ids, truth)
    for level in L.LEVELS:
        sizes = sorted(Counter(r["label"] for r in got.where(F.col("level") == level).collect()).values(), reverse=True)
        assert sizes == [12, 8] + [1] * 10
    assert L.random_control(ids).where("level = 'user'").select("label").distinct().count() == 5


def test_running_maximum_over_pieces(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 97 == 0, F.col("id")).alias("v"), F.lit("g").alias("g"))
    bad = running_max(rows, ["id"], ["g"], "v", "m").where("m <> floor(id / 97) * 97").count()
    assert bad == 0 and numbered(rows.where("false"), ["id"]).count() == 0


def test_prefixes_and_nesting(spark, make_log):
    log = make_log(("a", ["1"]), ("b", ["1", "2"]), ("c", ["1", "2", "3"]), ("d", ["2"]), ("e", None), ("f", []), ("g", ["1", None]), ("h", ["1", ""]))
    rows = canonical_requests(log, "messages")
    labels = {r["request_id"]: r["label"] for r in W.nesting_labels(rows).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "a", "h": "a"}
    d = {r["request_id"]: r["d"] for r in rows.select("request_id", prefix_digests(F.col("messages")).alias("d")).collect()}
    assert d["c"][:2] == d["b"] and d["g"][1] != d["h"][1] and len(set(d["c"])) == 3


def test_workflows_in_order(spark, make_log):
    log = make_log(("z", ["1"], "2026-01-01T00:02:00Z"), ("y", ["1", "2"], "2026-01-01T00:01:00Z"), ("x", ["1", "2", "3"], None), ("other", ["9"], "2026-01-01T00:00:00Z"))
    rows = canonical_requests(log, "messages")
    labels = rows.select("request_id", F.lit("s").alias("label"))
    truth = spark.createDataFrame([("z", "w", 1), ("y", "w", 2), ("x", "w", 3), ("other", "v", 1)], "request_id string, workflow string, turn int")
    order = [r["request_id"] for r in W.ordered_requests(rows, labels).orderBy("position").collect()]
    assert order == ["other", "z", "y", "x"]  # by predecessors, whatever the instants say
    got = W.reconstruct(rows, labels, truth).head()
    assert (got["majority_workflow"], got["majority_requests"], got["purity"], got["pairwise_order"], got["adjacent_order"]) == ("w", 3, 0.75, 1.0, 1.0)
    assert W.reconstruction_summary(W.reconstruct(rows.where("false"), labels, truth)).head()["workflows"] == 0


def test_sweep_and_best_point(spark):
    scored = spark.createDataFrame([("a", "b", 5.0, 0.9), ("b", "c", 4.0, 0.9), ("c", "d", 5.0, 0.1)], "left string, right string, s double, t double")
    ids = spark.createDataFrame([(x,) for x in "abcde"], "request_id string")
    truth = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "q"), ("e", "q")], "request_id string, label string")
    got = {(r["first_least"], r["second_least"]): r for r in W.threshold_sweep(scored, "s", "t", [(4.5, 0.5), (3.0, 0.0)], ids, truth).collect()}
    assert (got[4.5, 0.5]["linked_pairs"], got[4.5, 0.5]["clusters"], got[4.5, 0.5]["precision"]) == (1, 4, 1.0) and got[3.0, 0.0]["clusters"] == 2
    assert W.best_point(W.threshold_sweep(scored, "s", "t", [(4.5, 0.5), (3.0, 0.0)], ids, truth)).head()["first_least"] == 4.5


def test_paired_and_weighted_metrics(spark):
    rng = random.Random(1)
    rows = [(f"r{i:02}", f"t{i % 6}", f"u{i % 4}", f"w{i % 9}", i % 3) for i in range(60)]
    make = lambda k: spark.createDataFrame([(r[0], r[k]) for r in rows], "request_id string, label string")
    truth, unit, flow = make(1), make(2), make(3)
    noisy = spark.createDataFrame([(r[0], r[1] if rng.random() < 0.5 else "x") for r in rows], "request_id string, label string")
    got = E.paired_bootstrap(truth, noisy, truth, unit, 20, 3).head()
    assert got["left_f1"] == 1.0 and got["difference"] > 0 and got["left_ahead"] == 1.0
    weights = spark.createDataFrame([(r[0], r[4]) for r in rows], "request_id string, weight long")
    pred = {r["request_id"]: r["label"] for r in noisy.collect()}
    hit = said = true = 0.0
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[3] != b[3]:
                w = a[4] * b[4]
                said += w * (pred[a[0]] == pred[b[0]])
                true += w * (a[1] == b[1])
                hit += w * (a[1] == b[1] and pred[a[0]] == pred[b[0]])
    m = E.weighted_cross_f1(noisy, truth, flow, weights).head()
    assert m["precision"] == pytest.approx(hit / said) and m["recall"] == pytest.approx(hit / true)


def test_spans_masks_and_tokens(spark):
    rows = spark.createDataFrame([("r", [("tool", "short\nimport os and sys again\n" + "test " * 200, None), ("user", "IMPORT os and sys again", None), (None, None, None)]), ("s", None)], "request_id string, messages array<struct<role string, content string, name string>>")
    got = D.evidence_spans(rows).orderBy("rank").collect()
    assert [(r["rank"], r["role"], len(r["span"])) for r in got] == [(1, "tool", 23), (2, "tool", 480), (3, "tool", 39)]  # a chunk that repeats comes once
    one = spark.createDataFrame([("we do not use next.js here", "next.js"), ("we use next.js", "next.js"), ("nothing", "go_mod")], "a string, b string")
    assert [r["c"] for r in one.select(D.contradicted(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False, False]
    t = spark.createDataFrame([("(src/lib/core.py)", ["Ann"]), ("x", [""]), ("1234", ["a.b"])], "v string, n array<string>")
    assert [sorted(r["x"]) for r in t.select(D.expand_token(F.col("v")).alias("x")).collect()] == [["core.py", "src/lib/core", "src/lib/core.py"], [], []]
    assert [r["x"] for r in t.select(D.masked_document(F.lit("ann and a.b, Ann!"), F.col("n")).alias("x")).collect()] == ["[IDENTITY] and a.b, [IDENTITY]!", "ann and a.b, Ann!", "ann and [IDENTITY], Ann!"]
    said = spark.createDataFrame([("Please cancel order_1234. I want a refund; thanks.", f"id{i}") for i in range(6)], "t string, i string").select(D.rephrased_task(F.col("t"), F.col("i")).alias("x")).collect()
    assert len({r["x"] for r in said}) > 1 and all("terminate" in r["x"] and "1234" not in r["x"] for r in said)


def test_encoders_and_profiles(spark):
    docs = spark.createDataFrame([("a", "red green blue"), ("b", "red green"), ("c", "other words"), ("d", "")], "id string, text string")
    v = {r["id"]: r["vector"] for r in C.encode_documents(docs, C.hashing_encoder(64)).collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(v[x], v[y], strict=True))
    assert dot("a", "a") == pytest.approx(1) and dot("a", "b") > 0.5 > dot("a", "c") and sum(v["d"]) == 0
    weights = defaultdict(dict)
    for r in C.tfidf(docs).collect():
        weights[r["id"]][r["term"]] = r["weight"]
    assert weights["a"]["blue"] > weights["a"]["red"] and sum(w * w for w in weights["a"].values()) == pytest.approx(1)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left string, right string")
    got = C.combined_scores(pairs, C.encode_documents(docs, C.hashing_encoder(64)), C.tfidf(docs), 0.5, 0.2).collect()
    assert [(r["left"], r["right"]) for r in got] == [("a", "b")]
    spans = spark.createDataFrame([("r1", "pip install from pyproject"), ("r2", "pip install again"), ("r3", "never pip install")], "request_id string, span string")
    labels = spark.createDataFrame([("r1", "k"), ("r2", "k"), ("r3", "k")], "request_id string, label string")
    found = C.semantic_profiles(spans, {"managers": {"pip": "pip install", "npm": "npm run"}}, labels).collect()
    assert [(r["field"], r["value"], r["n_requests"]) for r in found] == [("managers", "pip", 2)]


def test_structured_scores_count_new_sources_and_requests(spark):
    o = spark.createDataFrame([("r1", "f", "v", "lexical", 1.0, 1), ("r1", "f", "v", "command", 2.0, 2), ("r2", "f", "v", "lexical", 1.0, 1), ("r1", "f", "w", "lexical", 1.0, 1), ("r3", "f", "v", "lexical", 1.0, 1)], "request_id string, field string, value string, source string, weight double, turn int")
    labels = spark.createDataFrame([("r1", "k"), ("r2", "k"), ("r3", "alone")], "request_id string, label string")
    got = [tuple(r) for r in D.structured_profiles(o, labels).collect()]
    assert got == [("k", "f", "v", 4.0, 2, ["command", "lexical"])]


def test_gate_pivot_and_rollup(spark):
    one = spark.createDataFrame([(5, None)], "a int, b double")
    assert tuple(A.scale_gate(one, {"a": (1, 9)}).head()) == (True, True) and tuple(A.scale_gate(one, {"a": (1, 9), "b": (None, 1.0)}).head()) == (True, False, False)
    m = spark.createDataFrame([("x", "user", 0.5), ("x", "org", 0.25)], "method string, level string, f1 double")
    assert tuple(A.summary_pivot(m, "method", "level", ["user", "org", "session"], "f1").head()) == ("x", 0.5, 0.25, None)
    r = A.risk_rollup(spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 0, 2), ("c", 9, 9, 9)], "field string, tp long, fp long, fn long"), {"high": ["a", "b"]}).head()
    assert (r["level"], r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == ("high", 2, 1, 2, 2 / 3, 0.5)
