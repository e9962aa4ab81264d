from pyspark.sql import functions as F

from tracemill.functions import features as X
from tracemill.operators import linkage as L
from tracemill.operators.requests import canonical_requests, request_text
from tracemill.sources.adapters import synthetic_features


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).head()["x"]


def test_repositories_from_fields_and_paths(spark):
    text = "see repository=acme/tool and /workspace/acme__other/src/a.py"
    assert sorted(one(spark, text, X.repositories)) == ["repo_full:acme/other", "repo_full:acme/tool", "repo_name:other", "repo_name:tool", "repo_owner:acme"]


def test_business_keys(spark):
    text = "tenant=blue customer_ref=c-12, account_cache=x:blue:acct:77 queue=blue-desk region=eu"
    assert sorted(one(spark, text, X.business_keys)) == ["business_org:tenant:blue", "business_project:queue:blue-desk", "business_user:account_cache:x:blue:acct:77", "business_user:customer_ref:c-12"]


def test_shingles_and_words(spark):
    text = "alpha beta gamma delta epsilon zeta"
    assert one(spark, text, X.shingles) == ["alpha beta gamma delta epsilon", "beta gamma delta epsilon zeta"]
    assert one(spark, "one two", X.shingles) == ["one", "two"]
    assert one(spark, "", X.shingles) == []
    assert one(spark, "The path src/lib/core.py and after /workspace/a.", X.words) == ["the", "path", "core.py", "and", "a"]


def test_bounded_text(spark):
    assert one(spark, "x" * 10, lambda c: X.bounded_text(c, 10)) == "x" * 10
    got = one(spark, "a" * 30 + "b" * 30, lambda c: X.bounded_text(c, 10))
    assert got == "aaaaa" + X.OMITTED + "bbbbb"


def test_set_similarities_of_empty_sides(spark):
    df = spark.createDataFrame([([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [tuple(r) for r in df.select(X.jaccard(F.col("a"), F.col("b")), X.containment(F.col("a"), F.col("b"))).collect()] == [(0.0, 0.0), (1 / 3, 0.5)]


def handles(spark, contents, roles=None):
    from tracemill.functions.handles import stable_handles

    rows = [([("user" if roles is None else roles[i], c, None) for i, c in enumerate(contents)],)]
    return spark.createDataFrame(rows, "messages array<struct<role string, content string, name string>>").select(stable_handles(F.col("messages")).alias("h")).head()["h"]


def test_handles(spark):
    payload = '{"reservation_id":"M05KNL","user_id":"aarav_ahmed_6699","flight_number":"HAT023","status":"available"}'
    assert handles(spark, [payload]) == ["stable_project:reservation:m05knl", "stable_user:user:aarav_ahmed_6699", "stable_context:flight:hat023"]
    assert "stable_project:reservation:m05knl" in handles(spark, ["My user ID is aarav_ahmed_6699 and reservation ID: M05KNL."])
    assert handles(spark, [None, "", "{broken", "[" * 5000]) == []
    assert handles(spark, [payload], ["system"]) == []


def test_handles_of_nested_payloads_and_odd_keys(spark):
    nested = '  {"order": {"items": [{"id": "A-100"}, {"id": 77}], "id": "#W123456"}, "Customer-IDs": ["x"], "customer_ids": "c_1", "id": "lone_1", "api_token_user_id": "u_9", "orgs": "acme_1", "organisation": "acme_2", "userId": "u_1", "count": true}'
    assert handles(spark, [nested]) == ["stable_org:organization:acme_2", "stable_context:item:a-100"]


def test_canonical_request_is_the_earliest_delivery(spark, make_log):
    log = make_log(("r", ["b"], "2022-01-02T00:00:00Z", "k"), ("r", ["a"], "2022-01-01T00:00:00Z", "k"), ("r", ["c"], None, "k"), (None, ["d"]), ("s", None), ("t", [...]), extra=("ms", "bucket"))
    got = {r["request_id"]: r for r in canonical_requests(log, "messages").withColumn("text", request_text(F.col("messages"))).collect()}
    assert got["r"]["text"] == "user::a" and set(got) == {"r", "s", "t"} and got["s"]["text"] == "" and got["t"]["text"] == "::"


def test_linkage_on_known_sessions(spark):
    f = synthetic_features(spark, 2, 40)
    labels = {(r["level"], r["request_id"]): r["label"] for r in L.low_cost(f.drop("truth_session", "truth_user")).collect()}
    truth = {r["request_id"]: r["truth_session"] for r in f.collect()}
    for a in truth:
        for b in truth:
            if a < b:
                assert (labels["session", a] == labels["session", b]) == (truth[a] == truth[b])


def test_feature_families_can_be_off_and_texts_missing(spark, make_log):
    log = make_log(("r", ["domain=x.internal /home/ann/a.txt trace-a-b"]), ("s", None), ("t", [None, "", ...]))
    rows = {r["request_id"]: r for r in L.feature_table(log, X.ablation("no_domains")).collect()}
    assert rows["r"]["domains"] == [] and rows["r"]["usernames"] == ["ann"] and rows["s"]["shingles"] == [] and rows["t"]["identifiers"] == []
    assert rows["r"]["traces"] == ["trace-a-b"]
