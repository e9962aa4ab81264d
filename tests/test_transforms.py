import pytest
from pyspark.sql import functions as F

from tracemill.operators import transforms as T
from tracemill.operators.ordered import numbered
from tracemill.operators.requests import canonical_requests


def contents(df):
    return {r["request_id"]: [m["content"] for m in r["messages"]] for r in df.collect()}


def test_stable_and_request_pseudonyms(spark, make_log):
    log = make_log(("r1", ["/workspace/owner__repo/a.py and /workspace/owner__repo/b.py"], "2022-01-01T00:00:00Z"), ("r2", ["/workspace/owner__repo/c.py", None], "2022-01-02T00:00:00Z"))
    rows = canonical_requests(log, "messages", "token_count")
    assert contents(T.pseudonymize_workspaces(rows)) == {"r1": ["/workspace/workspace_0001/a.py and /workspace/workspace_0001/b.py"], "r2": ["/workspace/workspace_0001/c.py", None]}
    assert contents(T.pseudonymize_workspaces(rows, "request")) == {"r1": ["/workspace/workspace_r1_001/a.py and /workspace/workspace_r1_001/b.py"], "r2": ["/workspace/workspace_r2_001/c.py", None]}


def test_text_transforms(spark, make_log):
    rows = canonical_requests(make_log(("r", ["open /workspace/owner__repo/src/app.py now sk-abcdefabcdefabcd postgres://u:p@h/x"])), "messages", "token_count")
    assert contents(T.map_contents(rows, T.path_type_only))["r"][0].startswith("open [WORKSPACE_PATH] now")
    assert contents(T.map_contents(rows, T.filter_secrets))["r"][0].endswith("now [SECRET] [CONNECTION_STRING]")
    strict = contents(T.map_contents(canonical_requests(make_log(("r", ["repository=owner/repo /workspace/owner__repo__1.0 api.team.internal"])), "messages", "token_count"), T.strict_sanitize))["r"][0]
    assert not any(x in strict for x in ("owner/repo", "owner__repo__1.0", "api.team.internal"))


def test_entities_are_numbered_by_first_occurrence_past_the_width(spark, make_log):
    log = make_log(*[(f"r{i:05}", [f"/tmp/f{i}.txt /tmp/f0.txt"], f"2022-01-01T00:{i // 60:02}:{i % 60:02}Z") for i in range(40)])
    rows = canonical_requests(log, "messages", "token_count")
    got = {r["value"]: r["placeholder"] for r in T.entity_dictionary(rows, r"/tmp/[a-z0-9.]+", "PATH", 1).collect()}
    assert got == {f"/tmp/f{i}.txt": f"[PATH_{i + 1}]" for i in range(40)}
    out = contents(T.redact_entities(rows, r"/tmp/[a-z0-9.]+", "PATH"))
    assert out["r00000"] == ["[PATH_0001] [PATH_0001]"] and out["r00007"] == ["[PATH_0008] [PATH_0001]"]


def test_turn_deltas(spark, make_log):
    log = make_log(("a", ["1", "2", "3"]), ("b", ["1", "2", "3", "4", "5"]), ("c", ["1", "2", "3", "4", "5"]), ("d", None))
    rows = canonical_requests(log, "messages").withColumn("w", F.lit("w")).withColumn("turn", F.ascii("request_id"))
    got = {r["request_id"]: [m["content"] for m in r["delta"]] for r in T.turn_deltas(rows, "w", "turn").collect()}
    assert got == {"a": ["1", "2", "3"], "b": ["4", "5"], "c": ["5"], "d": []}


def test_anchor_stress(spark):
    a = spark.createDataFrame([(f"r{i}", f"x{i % 3}") for i in range(30)], "request_id string, anchor string")
    assert T.retain_anchors(a, 0.0).count() == 0 and T.retain_anchors(a, 1.01).count() == 30
    assert T.rotate_anchors(a, 1.01).where("anchor not like '%rotated'").count() == 0
    assert T.collide_anchors(a, 0.0).exceptAll(a).count() == 0


def test_lineage_edits_rebuild_the_text(spark, make_log):
    rows = canonical_requests(make_log(("r1", ["repository=acme/tool about order_1234 and ORDER-1234 in /workspace/acme by api.team.internal"], "2022-01-01T00:00:00Z"), ("r2", ["order_1234 again in /workspace/other, user_nodigit", None, ""], "2022-01-02T00:00:00Z"), ("r3", None)), "messages")
    edits = T.span_lineage(rows)
    got = {(r["request_id"], r["message_index"]): r["content"] for r in T.apply_edits(rows, edits).collect()}
    assert got == {("r1", 0): "repository=owner_0001/repo_0001 about order_p000001 and order_p000002 in /workspace/workspace_0001 by service-0001.internal", ("r2", 0): "order_p000001 again in /workspace/workspace_0002, user_nodigit"}
    own = {(r["request_id"], r["original"]): r["replacement"] for r in T.span_lineage(rows, "request").collect()}
    assert own["r1", "order_1234"] == "order_p000001" and own["r2", "order_1234"] == "order_p000003"
    good = T.validate_lineage(rows, T.apply_lineage(rows, edits), edits).head()
    assert (good["requests"], good["edits"]) == (3, 7) and not any(good[c] for c in ("unmatched_requests", "changed_counts", "changed_shapes", "misplaced_edits", "unreproduced_contents"))
    bad = T.validate_lineage(rows, rows, edits.withColumn("start", F.col("start") + 1)).head()
    assert bad["misplaced_edits"] == 7 and bad["unreproduced_contents"] == 2


def test_contents_with_any_character_keep_their_placeholders(spark, make_log):
    rows = canonical_requests(make_log(("r", ["a\u0001 b /home/u1/x and /home/u2/y end", "/home/u2/y", ""])), "messages", "token_count")
    assert contents(T.redact_entities(rows, r"/home/[a-z0-9/]+", "PATH"))["r"] == ["a\u0001 b [PATH_0001] and [PATH_0002] end", "[PATH_0002]", ""]
    slugs = canonical_requests(make_log(("r", ["\u0001 /workspace/a__b/x /workspace/c__d"])), "messages", "token_count")
    assert contents(T.pseudonymize_workspaces(slugs, "request"))["r"] == ["\u0001 /workspace/workspace_r_001/x /workspace/workspace_r_002"]


def test_numbers_over_many_pieces_are_whole(spark):
    n = 400_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("value"), (F.col("id") * 7919 % n).alias("at"), (F.col("id") % 3).alias("kind"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for size, first in (("64m", "true"), ("1m", "false")):
            for k, v in zip(before, ("64", size, first), strict=True):
                spark.conf.set(k, v)
            got = numbered(rows, ["at"]).agg(F.count("*"), F.count_distinct("n"), F.max("n"), F.count_if(F.col("n") != F.col("at") + 1)).head()
            assert tuple(got) == (n, n, n, 0)
            each = numbered(rows, ["at"], ["kind"]).groupBy("kind").agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.max("n").alias("m")).collect()
            assert len(each) == 3 and all(r["c"] == r["d"] == r["m"] for r in each)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_defences_by_name(spark, make_log):
    log = make_log(("r", ["/workspace/a__b/x sk-abcdefabcdefabcd"], "2022-01-01T00:00:00Z"))
    rows = canonical_requests(log, "messages", "token_count")
    for name in [*T.DEFENSES, *T.COMPOSED]:
        assert T.apply_defense(rows, name).select("defense").head()["defense"] == name
    assert contents(T.apply_defense(rows, "M6"))["r"] == ["[PATH_0001] [SECRET]"]
    with pytest.raises(ValueError):
        T.apply_defense(rows, "M5")


def test_utility(spark, make_log):
    rows = canonical_requests(make_log(("r", ["/tmp/a.txt sk-abcdefabcdefabcd"])), "messages", "token_count")
    got = T.utility(rows, T.map_contents(rows, lambda c: T.filter_secrets(F.regexp_replace(c, "/tmp/[a-z.]+", "[P]")))).head()
    assert (got["paths_removed"], got["secrets_removed"], got["placeholders"]) == (1, 1, 1) and got["char_retention"] < 1
