import pytest

from tracemill.operators import evaluation as E


def labels(spark, **pairs):
    return spark.createDataFrame(list(pairs.items()), "request_id string, label string")


def test_pair_confusion(spark):
    got = E.pair_confusion(labels(spark, a="p", b="p", c="p", d="q"), labels(spark, a="x", b="x", c="y", d="y")).head().asDict()
    assert got == {"items": 4, "total_pairs": 6, "tp": 1, "fp": 2, "fn": 1, "tn": 2}


def test_cross_workflow(spark):
    truth, wf = labels(spark, a1="p", a2="p", b1="p", b2="p"), labels(spark, a1="A", a2="A", b1="B", b2="B")
    whole = E.cross_workflow_metrics(labels(spark, a1="c", a2="c", b1="c", b2="c"), truth, wf).head()
    assert (whole["f1"], whole["tp"], whole["truth_pairs"]) == (1.0, 4, 4)
    within = E.cross_workflow_metrics(labels(spark, a1="ca", a2="ca", b1="cb", b2="cb"), truth, wf).head()
    assert (within["precision"], within["recall"], within["f1"], within["predicted_pairs"]) == (0.0, 0.0, 0.0, 0)


def test_false_merges(spark):
    pred = labels(spark, **{f"r{i}": "one" for i in range(5)})
    truth = labels(spark, r0="a", r1="a", r2="b", r3="b", r4="b")
    got = E.false_merges(pred, truth).head()
    assert tuple(got) == (1, 5, 6, 1, 6.0)


def test_selective(spark):
    decisions = spark.createDataFrame([("a1", None, "abstain", 0.0), ("a2", "a1", "accept", 5.0), ("b1", None, "abstain", 0.0), ("b2", "a1", "accept", 4.0)], "request_id string, predecessor_id string, disposition string, score double")
    truth = labels(spark, a1="a", a2="a", b1="b", b2="b")
    got = E.selective_metrics(decisions, truth).head()
    assert (got["precision"], got["coverage"], got["abstained_share"]) == (0.5, 0.5, 0.5)
    curve = {r["threshold"]: (r["precision"], r["coverage"]) for r in E.risk_coverage(decisions, truth, [4.5, 3.5]).collect()}
    assert curve == {4.5: (1.0, 0.25), 3.5: (0.5, 0.5)}


def test_bound(spark):
    from pyspark.sql import functions as F

    p, f = E.equivalence_bound(F.col("k"), F.col("m"))
    got = [r["f"] for r in spark.createDataFrame([(1, 4), (2, 4), (4, 4), (9, 4)], "k int, m int").select(f.alias("f")).collect()]
    assert got == pytest.approx([1.0, 0.6, 1 / 3, 6 / 38])


def test_empty_tables_give_zeros(spark):
    none = labels(spark, a="x").where("false")
    got = E.clustering_metrics(none, none).head()
    assert (got["items"], got["f1"], got["purity"]) == (0, 0.0, 0.0)


def test_distances(spark):
    a = spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, None]], "v double")
    b = spark.createDataFrame([(x,) for x in [2.5, 3.5, 4.5]], "v double")
    assert E.ks_statistic(a, a, "v").head()[0] == 0
    assert E.ks_statistic(a, b, "v").head()[0] == pytest.approx(2 / 3)
    assert E.js_divergence(a, a, "v").head()[0] == pytest.approx(0)


def test_bootstrap_without_noise(spark):
    pred = labels(spark, **{f"r{i}": f"c{i // 3}" for i in range(60)})
    unit = labels(spark, **{f"r{i}": f"u{i // 6}" for i in range(60)})
    rows = E.bootstrap_f1(pred, pred, unit, 20, 3).collect()
    assert len(rows) == 20 and all(r["f1"] == 1.0 for r in rows)
    low = E.confidence_interval(E.bootstrap_f1(pred, pred, unit, 20, 3)).head()
    assert low["low"] == low["high"] == 1.0
