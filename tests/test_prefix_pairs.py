import random

from pyspark.sql import functions as F

from tracemill.operators import blocking as B
from tracemill.operators import linkage as L
from tracemill.scratch import Scratch


def test_pairs_without_features_have_the_scores_of_pairs_with_them(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        start = rng.randrange(0, 60)
        names = [rng.choice(["repo_full:a/b", "repo_full:c/d", "stable_x", "trace-1-2", "m-n", "o-p", "q-r"]) for _ in range(4)]
        rows.append((f"r{i:02}", list({*range(start, start + rng.randrange(1, 30)), -1, 100 + i % 5}), list(dict.fromkeys(names)), rng.sample(["a.corp", "b.corp", "c.corp"], rng.randrange(3))))
    rows.append(("none", [], [], []))
    f = spark.createDataFrame(rows, "request_id string, shingles array<bigint>, identifiers array<string>, domains array<string>")
    whole = L.pair_scores(B.candidate_pairs(B.postings(f, F.col("shingles")), 9), f, ("jaccard", "ids", "repo", "domain")).where("jaccard >= 0.08")
    columns = ["left", "right", "jaccard", "ids", "repo", "domain"]
    want = sorted(map(tuple, whole.select(columns).collect()))
    for slices in (1, 3, None):
        got = L.prefix_pairs(f, 9, Scratch(spark, "test"), slices=slices)
        assert sorted(map(tuple, got.select(columns).collect())) == want and want
