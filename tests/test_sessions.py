import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions.instants import instant_millis
from tracemill.operators.sessions import request_sessions, sessionize


def brute(events, gap):
    out = []
    for key in sorted({e[0] for e in events}):
        times = sorted(e[1] for e in events if e[0] == key)
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((key, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((key, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_stream_is_cut_over_partitions(spark, seed):
    rng = random.Random(seed)
    events = [("hot" if rng.random() < 0.6 else f"u{rng.randrange(9)}", rng.randrange(40_000)) for _ in range(3000)]
    df = spark.createDataFrame(events, "user string, at long").withColumn("start_ms", F.lit("clash"))
    got = sorted(tuple(r) for r in sessionize(df, ["user"], "at", 13).collect())
    assert got == brute(events, 13)


def test_equal_gap_ties_nulls_and_empty(spark):
    rows = [("a", 0), ("a", 10), ("a", 21), ("a", 21), ("a", None), (None, 5)]
    df = spark.createDataFrame(rows, "user string, at long")
    assert sorted(tuple(r) for r in sessionize(df, ["user"], "at", 10).collect()) == [("a", 0, 10, 2), ("a", 21, 21, 2)]
    assert sessionize(df.where("false"), ["user"], "at", 10).count() == 0


def test_instants(spark):
    cases = {
        "2022-01-03T02:36:23.954Z": 1641177383954, "2022-01-03T03:19:54.027+00:00": 1641179994027, "2022-01-02T18:48:43.657-08:00": 1641178123657, "2022-01-03 02:06:16Z": 1641175576000,
        "2022-01-03T02:06:16+0000": 1641175576000, "2022-01-03T02:06:16.123456789Z": 1641175576123, "2022-01-03": None, "": None, "soon": None, None: None, "12:30": None, "2022-13-40T00:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", instant_millis(F.col("t")).alias("ms"))
    assert {r["t"]: r["ms"] for r in df.collect()} == cases


def test_requests_count_once_and_missing_users_are_left_out(spark, make_log):
    log = make_log(("r1", [], "2022-01-01T00:00:00Z", "b"), ("r1", [], "2022-01-01T09:00:00Z", "b"), ("r2", [], "2022-01-01T00:30:00Z", "b"), ("r3", [], None, "b"), ("r4", [], "2022-01-01T00:00:00Z", " "), (None, [], "2022-01-01T00:00:00Z", "b"), extra=("user_id", "ms"))
    who = spark.createDataFrame([("r1", " User_1 "), ("r1", "none"), ("r2", "user_1"), ("r4", "USER_1"), ("r5", "user_1"), ("r3", "user_1"), ("r6", None)], "request_id string, user_id string")
    got = sorted(tuple(r) for r in request_sessions(log, who).collect())
    base = 1640995200000
    assert got == [("user_1", "b", base, base + 1_800_000, 2), ("user_1", "cache_unavailable", base, base, 1)]
