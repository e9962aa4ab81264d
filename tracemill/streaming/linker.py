"""The linker with a look-back window, over a whole log and over a stream.

Batch: candidates come from an equi-join on posting, bucket and time slot (a
slot is as long as the window, a request looks into its own slot and the one
before), so a join bucket is bounded by the posting cap and nothing depends on
the order of rows.  Stream: one keyed state per bucket that holds the states
of the window, expired by event time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import states as S
from ..ship import ship


def posted(states: DataFrame) -> DataFrame:
    """Postings of all families: ``bucket``, ``slot``, ``posting``, ``id``, ``second``."""
    values = F.concat(*[F.transform(c, lambda v, c=c: F.concat(F.lit(f"{c}:"), v.cast("string"))) for c in S.POSTINGS])
    return states.where("second is not null").select("bucket", F.floor(F.col("second") / S.WINDOW_SECONDS).alias("slot"), F.explode(values).alias("posting"), F.col("request_id").alias("id"), "second")


def candidates(states: DataFrame, cap: int = S.POSTING_CAP, most: int | None = S.CANDIDATES, window: int = S.WINDOW_SECONDS) -> DataFrame:
    """Distinct pairs ``earlier``, ``later`` that share a posting within the window.

    Postings over the cap in a slot are suppressed; a request keeps the first
    ``most`` candidates by id (all with None).
    """
    p = posted(states)
    kept = p.join(p.groupBy("bucket", "slot", "posting").count().where((F.col("count") <= cap)).drop("count"), ["bucket", "slot", "posting"])
    late = kept.select("bucket", F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"), "posting", F.col("id").alias("later"), F.col("second").alias("ls"))
    early = kept.select("bucket", "slot", "posting", F.col("id").alias("earlier"), F.col("second").alias("es"))
    pairs = late.join(early, ["bucket", "slot", "posting"])
    before = (F.col("es") < F.col("ls")) | ((F.col("es") == F.col("ls")) & (F.col("earlier") < F.col("later")))
    found = pairs.where(before & (F.col("ls") - F.col("es") <= window)).select("earlier", "later").distinct()
    if most is None:
        return found
    w = Window.partitionBy("later").orderBy("earlier")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def link_states(states: DataFrame, rules: S.LinkRules = S.VARIANTS["full"], cap: int = S.POSTING_CAP, most: int | None = S.CANDIDATES) -> DataFrame:
    """The decision on every request of a log: its best predecessor within the window, or why there is none.

    Requests without an instant abstain for want of a candidate; rows that come
    late are in their place by their instant.
    """
    pairs = candidates(states, cap, most, rules.window)
    need = ["request_id", "second", "message_count", *S.COMPARED]
    side = lambda tag: states.select(*[F.col(c).alias(f"{tag}_{c}") for c in need])
    both = pairs.join(side("e"), F.col("earlier") == F.col("e_request_id")).join(side("l"), F.col("later") == F.col("l_request_id"))
    w = Window.partitionBy("later_id").orderBy(F.desc("score"), "earlier_id")
    best = S.evidence(both, rules).withColumn("r", F.row_number().over(w)).withColumn("runner_up_score", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("r = 1").drop("r")
    return S.decide(states.select("request_id").join(best.withColumnRenamed("later_id", "request_id"), "request_id", "left"), rules)


def peak_concurrency(intervals: DataFrame, start: str, end: str, key: str | None = None) -> DataFrame:
    """Most intervals open at once (ends count before starts of the same instant), per key or over all.

    Over all, instants are summed per value first, so the running sum goes over
    distinct instants.
    """
    keys = [key] if key else []
    intervals = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    steps = intervals.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = steps.groupBy(*keys, "t", "d").agg(F.sum("d").alias("s"))
    w = Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("open", F.sum("s").over(w))
    return run.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("open")).alias("peak"))


DECISIONS = "request_id string, predecessor_id string, disposition string, score double, reason string, active long"
_KEPT = S.COMPARED


class _No:
    """A truth value with ``&``, ``|`` and ``~`` as columns have them."""

    __slots__ = ("value",)

    def __init__(self, value: bool):
        self.value = bool(value)

    def __and__(self, other):
        return _No(self.value and bool(other))

    def __or__(self, other):
        return _No(self.value or bool(other))

    def __invert__(self):
        return _No(not self.value)

    def __bool__(self):
        return self.value


def _compare(e: dict, l: dict, rules: S.LinkRules) -> tuple[float, dict, list[str], dict]:  # noqa: E741
    """Score, families, conflicts and the compared numbers of two states, by the rules of the batch."""
    v: dict = {f: len(e[f] & l[f]) for f in _KEPT}
    both = {f: bool(e[f] and l[f]) for f in ("user_handles", "org_handles", "initial")}
    v |= {f"apart_{f}": both[f] and not v[f] for f in ("user_handles", "org_handles")}
    v |= {"both_initial": both["initial"], "delta": l["second"] - e["second"], "growth": l["n"] - e["n"], "replay": v["replay"] / len(e["replay"]) if e["replay"] else 0.0, "initial": v["initial"] / len(e["initial"]) if e["initial"] else 0.0}
    families, conflicts, score = S.judge(v, rules, min, int)
    return score, families, [c for c, hit in conflicts.items() if hit], v


class BucketLinker:
    """The requests of one bucket in order of event time, with postings, suppression and expiry.

    ``held`` are the states of the window; postings of more than ``cap`` held
    requests are suppressed for good, and a request is compared with the first
    ``most`` of those it shares a posting with.
    """

    def __init__(self, held: list[dict], suppressed: list[str], rules: S.LinkRules, cap: int, most: int | None):
        self.rules, self.cap, self.most = rules, cap, most
        self.suppressed = set(suppressed)
        self.held: dict[str, dict] = {}
        self.postings: dict[str, dict[str, None]] = {}
        self.order: list[tuple[int, str]] = []
        for h in held:
            self._add(h)

    @staticmethod
    def _values(x: dict) -> list[str]:
        return [f"{f}:{v}" for f in S.POSTINGS for v in x[f]]

    def _add(self, x: dict) -> None:
        self.held[x["id"]] = x
        self.order.append((x["second"], x["id"]))
        for value in self._values(x):
            if value in self.suppressed:
                continue
            listed = self.postings.setdefault(value, {})
            listed[x["id"]] = None
            if len(listed) > self.cap:
                del self.postings[value]
                self.suppressed.add(value)

    def _expire(self, now: int) -> None:
        gone = [x for x in self.order if now - x[0] > self.rules.window]
        if not gone:
            return
        self.order = [x for x in self.order if now - x[0] <= self.rules.window]
        for _, key in gone:
            for value in self._values(self.held.pop(key)):
                listed = self.postings.get(value)
                if listed is not None:
                    listed.pop(key, None)
                    if not listed:
                        del self.postings[value]

    def link(self, now: dict) -> tuple:
        """The decision on a request, which is held from then on."""
        self._expire(now["second"])
        near: set[str] = set()
        for value in self._values(now):
            near.update(self.postings.get(value, ()))
        near = {k for k in near if 0 <= now["second"] - self.held[k]["second"] <= self.rules.window}
        chosen = sorted(near) if self.most is None else sorted(near)[: self.most]
        ranked = sorted(((*_compare(self.held[k], now, self.rules), k) for k in chosen), key=lambda x: (-x[0], x[4]))
        active = len(self.held)
        if not ranked:
            out = (now["id"], None, "abstain", 0.0, "no_candidate", active)
        else:
            score, families, conflicts, v, key = ranked[0]
            runner_up = ranked[1][0] if len(ranked) > 1 else 0.0
            told = {f: _No(families.get(f, False)) for f in S.FAMILIES} | {"n_conflicts": len(conflicts), "delta": v["delta"], "resources": v["resources"], "score": score, "n_families": sum(map(bool, families.values())), "margin": score - runner_up}
            verdict, why = next(((d, r) for hit, d, r in S.gate(told, self.rules) if hit), ("accept", "risk_gate_passed"))
            out = (now["id"], key, verdict, score, why, active)
        self._add(now)
        return out


def _pack(linker: BucketLinker) -> str:
    return json.dumps([[{**h, **{f: sorted(h[f]) for f in _KEPT}} for h in linker.held.values()], sorted(linker.suppressed)])


def _unpack(text: str | None) -> tuple[list[dict], list[str]]:
    if not text:
        return [], []
    held, suppressed = json.loads(text)
    return [{**h, **{f: set(h[f]) for f in _KEPT}} for h in held], suppressed


def link_stream(states: DataFrame, rules: S.LinkRules = S.VARIANTS["full"], cap: int = S.POSTING_CAP, most: int | None = S.CANDIDATES) -> DataFrame:
    """Decisions on a stream of states, in append mode.

    Rows later than the watermark (the window) are dropped by Spark; within it,
    a late row is compared with what came before its instant and is held for
    those after it.  Requests without an instant can't be placed in event time
    and are left out.  The state of a bucket is bounded by the requests of its
    window, the work of a request by its postings' cap and ``most``.
    """
    ship(states.sparkSession)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        linker = BucketLinker(*_unpack(state.get[0] if state.exists else None), rules, cap, most)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["second", "request_id"])
        out = [linker.link({"id": r.request_id, "second": int(r.second), "n": int(r.message_count), **{f: set(getattr(r, f)) for f in _KEPT}}) for r in rows.itertuples(index=False)]
        state.update((_pack(linker),))
        newest = max(h["second"] for h in linker.held.values())
        if (newest + rules.window) * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp((newest + rules.window) * 1000)
        names = [c.split()[0] for c in DECISIONS.split(", ")]
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object if n in ("request_id", "predecessor_id", "disposition", "reason") else None) for i, n in enumerate(names)})

    timed = states.where("second is not null").withColumn("event_time", F.timestamp_seconds("second")).withWatermark("event_time", f"{rules.window} seconds")
    kept = timed.select("bucket", "request_id", "second", "message_count", "event_time", *[F.transform(f, lambda v: v.cast("string")).alias(f) for f in _KEPT])
    return kept.groupBy("bucket").applyInPandasWithState(advance, DECISIONS, "states string", "append", GroupStateTimeout.EventTimeTimeout)
