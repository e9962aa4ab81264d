import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import linkage as L
from tracemill.operators.requests import canonical_requests
from tracemill.sources import adapters as A
from tracemill.sources import generators as G
from tracemill.sources import io as IO
from tracemill.sources.loose import loose_messages, messages_of


def test_lines_round_trip_blank_lines_and_stream(spark, make_log, tmp_path):
    log = make_log(("r1", ["a\nb", None], "2026-01-01T00:00:00Z", "k"), ("r2", None))
    IO.write_lines(log, str(tmp_path / "lines"))
    back = IO.read_lines(spark, str(tmp_path / "lines"))
    assert sorted(map(str, back.collect())) == sorted(map(str, log.select(*back.columns).collect()))
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "x.json").write_text('\n{"request_id": "q"}\n\n')
    assert [r["request_id"] for r in IO.read_lines(spark, str(tmp_path / "blank")).where("request_id is not null").collect()] == ["q"]
    q = IO.stream_lines(spark, str(tmp_path / "lines"), files_per_trigger=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_any_source(spark, tmp_path):
    (tmp_path / "wrapped.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    got = IO.read_any(spark, str(tmp_path / "wrapped.json"), "json").collect()
    assert sorted(r["a"] for r in got) == [1, 2] and got[0]["_source_file"].endswith("wrapped.json")
    (tmp_path / "rows.jsonl").write_text('{"a": 3}\n')
    assert IO.read_any(spark, str(tmp_path / "rows.jsonl"), "jsonl").head()["a"] == 3
    spark.range(2).write.parquet(str(tmp_path / "p"))
    assert IO.read_any(spark, str(tmp_path / "p"), "parquet").count() == 2
    with pytest.raises(ValueError):
        IO.read_any(spark, "x", "xml")


def test_tables_and_summaries(spark, tmp_path):
    IO.write_table([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")], str(tmp_path / "csv"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()
    assert {(r["a"], r["b"]) for r in rows} == {("1", None), (None, "x")}
    df = spark.createDataFrame([("a|b", 0.12345), (None, 1.0)], "k string, v double")
    assert IO.markdown(df) == "| k | v |\n| --- | --- |\n| a\\|b | 0.123 |\n|  | 1.000 |\n"
    assert json.loads(IO.summary_json(df.limit(1))) == {"k": "a|b", "v": 0.12345} and IO.summary_json(df.where("false")) == "{}"


def test_removed_columns_are_counted(spark, make_log):
    log = make_log(("r", ["x"]), ("s", None)).withColumns({"label": F.lit(1), "note": F.when(F.col("request_id") == "r", "n")})
    assert {tuple(r) for r in IO.removed_fields(log).collect()} == {("label", 2), ("note", 1)}


def test_spread_and_repair_and_replay_and_times(spark):
    got = spark.createDataFrame([(list(range(30)),), (list(range(5)),), ([],)], "p array<int>").select(A.spread_turns(F.col("p"), 4).alias("x")).collect()
    assert [r["x"] for r in got] == [[0, 7, 15, 22], [0, 1, 2, 3], []]
    m = spark.createDataFrame([("crash", "diff", "own/repo")], "i string, p string, r string").select(A.repair_workflow(F.col("i"), F.col("p"), F.col("r")).alias("m")).head()["m"]
    assert [x["role"] for x in m] == ["user", "assistant", "tool", "assistant", "tool", "assistant", "tool", "assistant"] and m[4]["content"] == "diff"
    rows = spark.createDataFrame([("a", 5), ("b", None)], "request_id string, ms long")
    assert sorted((r["request_id"], r["ms"]) for r in A.replay(rows, 2, 100).where("ms is not null").collect()) == [("a#0", 5), ("a#1", 105)]
    t = spark.createDataFrame([("w", 1, "a", 10), ("w", 2, "b", 10), ("w", 3, "c", 5), ("w", 4, "d", 50)], "g string, o int, request_id string, s long")
    assert [r["s"] for r in A.monotone_times(t, "g", "o", "s").orderBy("o").collect()] == [10, 11, 12, 50]


def test_loose_trajectories(spark):
    assert messages_of('[{"role": "user", "content": [{"type": "text", "text": "hi"}]}]') == [{"role": "user", "content": "hi", "name": None}]
    assert messages_of(json.dumps(json.dumps({"trajectory": [{"thought": "t", "action": "a", "observation": "o", "tool": "ls"}]}))) == [{"role": "assistant", "content": "t", "name": None}, {"role": "assistant", "content": "a", "name": None}, {"role": "tool", "content": "o", "name": "ls"}]
    assert messages_of("plain") == [{"role": "user", "content": "plain", "name": None}] and messages_of("") == [] and messages_of("{broken")[0]["content"] == "{broken"
    df = spark.createDataFrame([('{"history": ["x", {"from": "gpt", "value": "y"}]}',), (None,)], "t string")
    assert [[(m["role"], m["content"]) for m in r["m"]] for r in df.select(loose_messages(F.col("t")).alias("m")).collect()] == [[("user", "x"), ("gpt", "y")], []]


def test_generated_log_is_linked_back(spark):
    log, truth = G.generated_log(spark, 12, 4, noise=0.1)
    rows = canonical_requests(log.withColumn("token_count", F.lit(1)), "messages")
    assert rows.count() == 48 and truth.select("user_id").distinct().count() > 2
    times = truth.join(rows.select("request_id", "ms"), "request_id").where("workflow_id like 'wf%' and length(workflow_id) = 11").orderBy("workflow_id", "turn_id").collect()
    assert all(a["ms"] <= b["ms"] for a, b in zip(times, times[1:], strict=False) if a["workflow_id"] == b["workflow_id"])
    again, _ = G.generated_log(spark, 12, 4, noise=0.1)
    assert again.exceptAll(log).count() == 0


def test_exchangeable_sessions_cannot_be_told_apart(spark):
    f = A.synthetic_features(spark, 1, 40)
    alike = G.exchangeable_features(f, 2)
    labels = L.low_cost(alike.drop("truth_session", "truth_user")).where("level = 'session'")
    assert labels.select("label").distinct().count() == 5


def test_summary_file_and_sizes_of_states(spark, make_log, tmp_path):
    from tracemill.operators import states as S

    IO.write_json(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text(encoding="utf-8")) == {"a": 1, "b": "é"}
    states = S.agent_states(make_log(("r", ["read order_778899 in /workspace/a"], "2026-01-01T00:00:00Z", "k"), ("s", None)))
    got = {r["request_id"]: (r["n"], r["b"]) for r in states.select("request_id", S.state_size().alias("n"), S.state_bytes().alias("b")).collect()}
    assert got["s"] == (0, 160 + 49 + len("cache_unavailable")) and got["r"][0] >= 5 and got["r"][1] > 160 + 49 * got["r"][0]


def test_methods_by_name(spark):
    f = A.synthetic_features(spark, 1, 12).drop("truth_session", "truth_user")
    got = L.run_methods(f, ["temporal", "tool", "rare", "random"])
    assert {r["method"]: r["n"] for r in got.groupBy("method").agg(F.count("*").alias("n")).collect()} == {m: 48 for m in ("temporal", "tool", "rare", "random")}
    with pytest.raises(ValueError):
        L.run_methods(f, ["nothing"])


def test_merges_above_the_session(spark):
    from tracemill.operators import states as S

    sessions = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "request_id string, label string")
    empty = []
    states = spark.createDataFrame([("a", ["stable_user:user:u_1"], empty, empty), ("b", empty, ["stable_project:queue:q_1"], empty), ("c", ["stable_user:user:u_1"], ["stable_project:queue:q_1"], empty), ("d", empty, empty, ["stable_org:org:o_1"])], "request_id string, user_handles array<string>, project_handles array<string>, org_handles array<string>")
    got = {(r["level"], r["request_id"]): r["label"] for r in S.higher_levels(sessions, states).collect()}
    assert [got["user", x] for x in "abcd"] == ["a", "a", "a", "d"]
    assert [got["project", x] for x in "abcd"] == ["a", "a", "c", "d"]  # a queue is no kind that merges
    assert [got["org", x] for x in "abcd"] == ["a", "a", "c", "d"]
