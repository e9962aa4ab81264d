import __spark_entry__ as e


def test_hot_value_links_all_its_requests(spark, make_log, tmp_path):
    rows = [(f"r{i:02}", ["see api.build.internal"], "2026-01-01T00:00:00Z", "b") for i in range(60)]
    make_log(*rows).write.parquet(str(tmp_path / "attack_view.parquet"))
    run = lambda name: e.queries()[name](spark, str(tmp_path)).collect()
    star = {("r00", f"r{i:02}") for i in range(1, 60)}
    assert {(r["u"], r["v"]) for r in run("q_star_edges")} == star
    assert {(r["id"], r["label"]) for r in run("q_components")} == {(f"r{i:02}", "r00") for i in range(60)}
    # the pair queries give an oversized bucket as a representative and its members
    assert {(r["left"], r["right"]) for r in run("q_candidate_pairs")} == star
    assert {(r["left"], r["right"], *r["anchors"]) for r in run("q_anchor_pairs")} == {(*p, "api.build.internal") for p in star}
