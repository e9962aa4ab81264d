import random
from itertools import combinations

import __spark_entry__ as e
from tracemill.operators import linkage as L


def groups(rows, level):
    return {r["request_id"]: r["label"] for r in rows if r["level"] == level}


def test_hot_shingles_and_the_middle_of_long_texts_link(spark, make_log, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i:05}" for i in range(n))
    hot = [(f"h{i:02}", ["alpha beta gamma delta epsilon zeta"]) for i in range(45)]  # more than 40 hold each shingle
    long = [(name, [f"{words(name + 'x', 6000)} {words('mid', 12000)} {words(name + 'y', 6000)}"]) for name in ("la", "lb")]
    make_log(*hot, *long, ("z", ["nothing in common with any other of them here"]), ("none", None)).write.parquet(str(tmp_path / "attack_view.parquet"))
    got = groups(e.queries()["q_prefix"](spark, str(tmp_path)).collect(), "session")
    assert got == {**{name: "h00" for name, _ in hot}, "la": "la", "lb": "la", "z": "z", "none": "none"}


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(90):
        start = rng.randrange(0, 400)
        names = [rng.choice(["repo_full:a/b", "repo_full:c/d", "repo_full:e/f", "stable_x", "m-n", "o-p", "q-r", f"own-{i}"]) for _ in range(3)]
        rows.append((f"r{i:02}", list({*range(start, start + rng.randrange(1, 40)), *range(1000, 1000 + rng.randrange(0, 6)), -i - 1}), list(dict.fromkeys(names)), rng.sample(["a.corp", "b.corp", "c.corp"], rng.randrange(3))))
    rows.append(("none", [], ["m-n", "o-p", "q-r"], []))
    label = {level: {r[0]: r[0] for r in rows} for level in L.LEVELS}
    for a, b in combinations(rows, 2):
        shared = len(set(a[1]) & set(b[1]))
        alike = shared / (len(a[1]) + len(b[1]) - shared) if shared else 0
        both = set(a[2]) & set(b[2])
        ids, repo, domain = sum(not v.startswith("stable_") for v in both), sum(v.startswith("repo_full:") for v in both), len(set(a[3]) & set(b[3]))
        for level, linked in {"session": alike >= 0.22, "user": alike >= 0.12 and ids >= 3, "project": alike >= 0.08 and repo >= 1, "org": alike >= 0.08 and domain + ids >= 3}.items():
            if linked:
                old, new = sorted((label[level][a[0]], label[level][b[0]]), reverse=True)
                label[level] = {k: new if v == old else v for k, v in label[level].items()}
    f = spark.createDataFrame(rows, "request_id string, shingles array<bigint>, identifiers array<string>, domains array<string>")
    for block in (None, 7):
        got = L.prefix(f, block).collect()
        assert len(got) == 4 * len(rows)
        for level in L.LEVELS:
            assert groups(got, level) == label[level] and len(set(label[level].values())) < len(rows)


def test_no_requests_and_no_shared_values(spark):
    schema = "request_id string, shingles array<bigint>, identifiers array<string>, domains array<string>"
    assert L.prefix(spark.createDataFrame([], schema)).collect() == []
    assert groups(L.prefix(spark.createDataFrame([("a", [1], [], []), ("b", [2], [], [])], schema)).collect(), "org") == {"a": "a", "b": "b"}
