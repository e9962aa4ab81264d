import random

from pyspark.sql import functions as F

from tracemill.operators import encoders as C
from tracemill.operators import similarity as S
from tracemill.operators import states as A
from tracemill.operators import watchlists as W
from tracemill.scratch import Scratch
from tracemill.streaming import linker as K

TEXTS = ["Please refund order_778899 for customer_alpha001.", "I will check the order before refunding.", '{"order_id":"order_778899","status":"delivered","user_id":"alpha_0001"}', "The order is delivered."]
OTHER = ["Cancel reservation_ABC123 for account_gamma003.", "I will check the fare class and departure time.", '{"reservation_id":"reservation_ABC123","user_id":"gamma_0003"}']


def log(make_log):
    return make_log(
        ("a1", TEXTS[:1], "2026-02-01T09:00:10Z", "retail"), ("a2", TEXTS[:3], "2026-02-01T09:00:49Z", "retail"), ("b1", OTHER[:1], "2026-02-01T09:01:00Z", "retail"), ("b2", OTHER[:3], "2026-02-01T09:02:00Z", "retail"),
        ("late", TEXTS[:4], "2026-02-01T19:00:00Z", "retail"), ("none", None, None, None),
    )


def test_batch_decisions(spark, make_log):
    got = {r["request_id"]: (r["predecessor_id"], r["disposition"], r["reason"]) for r in K.link_states(A.agent_states(log(make_log))).collect()}
    assert got["a2"] == ("a1", "accept", "risk_gate_passed") and got["b2"] == ("b1", "accept", "risk_gate_passed")
    for r in ("a1", "b1", "late", "none"):
        assert got[r] == (None, "abstain", "no_candidate")


def test_stream_agrees_with_batch(spark, make_log):
    scratch = Scratch(spark, "test")
    states = scratch.save(A.agent_states(log(make_log)), "states")
    states.coalesce(1).write.parquet(scratch.path("in"))
    read = spark.readStream.schema(states.schema).parquet(scratch.path("in"))
    K.link_stream(read).writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("marks")).trigger(availableNow=True).start().awaitTermination()
    got = {r["request_id"]: (r["predecessor_id"], r["disposition"], r["active"]) for r in spark.read.schema(K.DECISIONS).parquet(scratch.path("out")).collect()}
    assert got == {"a1": (None, "abstain", 0), "a2": ("a1", "accept", 1), "b1": (None, "abstain", 2), "b2": ("b1", "accept", 3), "late": (None, "abstain", 0)}


def test_hot_posting_is_suppressed(spark, make_log):
    rows = make_log(*[(f"r{i:02}", TEXTS[:1], f"2026-02-01T09:{i:02}:00Z", "b") for i in range(30)])
    states = A.agent_states(rows)
    assert K.candidates(states, cap=4).count() == 0
    assert K.candidates(states, cap=64).count() == 435


def test_peak(spark):
    df = spark.createDataFrame([(0, 10), (5, 15), (10, 20), (None, 3)], "a long, b long")
    assert K.peak_concurrency(df, "a", "b").head()["peak"] == 2


def test_similarity(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    top = S.top_k_cosine(v, v, 1)
    assert {r["query_id"]: r["id"] for r in top.collect()}[1] == 2
    assert [(r["left"], r["right"]) for r in S.mutual_neighbours(S.top_k_cosine(v, v, 2), 0.05).collect()] == [(1, 2)]
    assert S.top_k_cosine(v.where("false"), v, 3).count() == 0


def test_index_of_cells(spark):
    """Rows in groups: the index finds nearly all neighbours and compares few rows."""
    rows = spark.range(1200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.sin(F.floor(F.col("id") / 20) * 7 + i * i) + 0.1 * F.sin(F.col("id") * (i + 1))).cast("float")).alias("embedding"))
    q = rows.where("vec_id % 50 = 0")
    got = C.index_report(rows, q, S.top_k_cosine(rows, q, 5), 5).head()
    assert got["recall"] >= 0.9 and got["compared_share"] < 0.2
    with_nulls = rows.unionByName(spark.createDataFrame([(5000, None)], "vec_id long, embedding array<float>"))
    assert C.index_report(with_nulls, q, S.top_k_cosine(rows, q, 5), 5).head()["recall"] >= 0.9
    assert C.index_report(rows.where("false"), q, S.top_k_cosine(rows, q, 5), 5).head()["found"] == 0


def test_nearest_earlier_text_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        base = rows[rng.randrange(len(rows))][2].split() if rows and rng.random() < 0.6 else rng.sample(words, 12)
        rows.append((f"r{i:03}", i * 100, " ".join([*base, rng.choice(words)])))
    df = spark.createDataFrame([*rows, ("none", None, "x"), ("empty", 50, None)], "request_id string, second long, text string")
    places = {r["request_id"]: r["p"] for r in df.select("request_id", C.hashed_places(C.terms(F.col("text")), 1 << 15).alias("p")).collect()}

    def vector(i):
        out = {}
        for p in places[i] or []:
            out[p] = out.get(p, 0) + 1
        n = sum(x * x for x in out.values()) ** 0.5
        return {k: x / n for k, x in out.items()}

    order = sorted((s, i) for i, s, _ in [*rows, ("empty", 50, None)])
    want = {}
    for n, (s, i) in enumerate(order):
        scored = sorted(((round(sum(x * vector(j).get(k, 0) for k, x in vector(i).items()), 6), j) for t, j in order[max(0, n - 20) : n] if s - t <= 2_000), reverse=True)
        best, second = (scored[0] if scored else (0.0, None)), (scored[1][0] if len(scored) > 1 else 0.0)
        want[i] = (best[1], best[0], "accept" if scored and best[0] >= 0.72 and best[0] - second >= 0.04 else "abstain")
    got = {r["request_id"]: r for r in C.nearest_earlier(df, window_seconds=2_000, active=20).collect()}
    assert got["none"]["disposition"] == "abstain" and len(got) == len(rows) + 2
    for i, (best, score, verdict) in want.items():
        assert abs(got[i]["score"] - score) < 2e-6 and got[i]["disposition"] == verdict, i
    assert sum(v[2] == "accept" for v in want.values()) > 10


def test_heavy_hitters_candidates_and_late_rows_in_the_bucket_linker():
    rules = A.VARIANTS["full"]
    state = lambda i, second, replay=(), user=(): {"id": i, "second": second, "n": 1, **{f: set() for f in A.COMPARED}, "replay": set(replay), "user_handles": set(user)}
    linker = K.BucketLinker([], [], rules, cap=3, most=2)
    for n in range(5):
        linker.link(state(f"r{n}", n, ["hot"]))
    assert linker.suppressed == {"replay:hot"} and linker.link(state("r9", 9, ["hot"]))[4] == "no_candidate"
    linker = K.BucketLinker([], [], rules, cap=64, most=2)
    for n in range(5):
        linker.link(state(f"r{n}", n, ["x"], ["u"]))
    assert linker.link(state("late", 2, ["x"], ["u"]))[1] == "r0"  # later ones are no predecessors, and of the earlier ones two are compared
    assert linker.link(state("after", 2 + rules.window, ["x"], ["u"]))[5] == 4 and "r0" not in linker.held
    again = K.BucketLinker(*K._unpack(K._pack(linker)), rules, 64, 2)
    assert set(again.held) == set(linker.held) and again.postings.keys() == linker.postings.keys()


def test_watchlist(spark):
    tokens = spark.createDataFrame([("a1", "repo"), ("a2", "repo"), ("b1", "other"), ("b2", "other"), ("x", "repo"), ("x", "other"), ("x", "repo2"), ("a1", "repo2"), ("a2", "repo2")], "request_id string, token string")
    labels = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B")], "request_id string, label string")
    wl = W.token_watchlist(tokens, labels)
    assert {(r["label"], r["token"]) for r in wl.collect()} == {("A", "repo"), ("A", "repo2"), ("B", "other")}
    got = W.assign(tokens.where("request_id = 'x'"), wl, least_score=1.0).collect()
    assert [(r["request_id"], r["label"], r["hits"]) for r in got] == [("x", "A", 2)]
    assert [(r["request_id"], r["label"]) for r in W.vote(tokens.withColumnRenamed("token", "anchor"), W.unique_anchors(tokens.withColumnRenamed("token", "anchor"), labels)).where("request_id = 'x'").collect()] == [("x", "A")]
    assert W.profile_scores(spark.createDataFrame([("e", "f", "seen"), ("e", "f", "wrong")], "entity string, field string, value string"), spark.createDataFrame([("e", "f", "seen")], "entity string, field string, value string")).where("field = '__micro__'").head()["precision"] == 0.5
