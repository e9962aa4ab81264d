"""Audits of what requests expose: anchors and handles against truth, costs, and splits.

``anchors``: ``request_id``, ``anchor`` (distinct pairs).  ``truth``:
``request_id``, ``label``, ``workflow``.  A ratio with an empty denominator is
0; every number is a grouped count, so a hot anchor or entity is one row after
its partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import ratio
from .ordered import numbered


def _share(hits: Column, of: Column) -> Column:
    return ratio(F.coalesce(hits, F.lit(0)).cast("double"), of.cast("double"))


def exposure(truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: how far the anchors of requests give away their labels.

    Shares of requests with an anchor, with the right one, with several, with
    none but wrong ones; of workflows with the right one in any or in all
    turns; of labels with it in any request.
    """
    seen = anchors.join(truth.select("request_id", "label"), "request_id").groupBy("request_id").agg(F.count("*").alias("n"), F.max((F.col("anchor") == F.col("label")).cast("int")).alias("right"))
    rows = truth.join(seen, "request_id", "left").select("request_id", "label", "workflow", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("right", F.lit(0)).alias("right"))
    by_request = rows.agg(F.count("*").alias("requests"), F.count_if(F.col("n") > 0).alias("exposed"), F.sum("right").alias("exact"), F.count_if(F.col("n") > 1).alias("several"), F.count_if((F.col("n") > 0) & (F.col("right") == 0)).alias("wrong"))
    by_workflow = rows.where("workflow is not null").groupBy("workflow").agg(F.max("right").alias("any"), F.min("right").alias("every")).agg(F.count("*").alias("workflows"), F.sum("any").alias("any"), F.sum("every").alias("every"))
    by_entity = rows.groupBy("label").agg(F.max("right").alias("met")).agg(F.count("*").alias("entities"), F.sum("met").alias("met"))
    c = F.col
    one = by_request.crossJoin(by_workflow).crossJoin(by_entity)  # three single rows
    return one.select(
        "requests", "workflows", "entities", _share(c("exposed"), c("requests")).alias("coverage"), _share(c("exact"), c("requests")).alias("exact_share"), _share(c("several"), c("requests")).alias("ambiguous_share"), _share(c("wrong"), c("requests")).alias("incorrect_share"),
        _share(c("any"), c("workflows")).alias("workflow_any"), _share(c("every"), c("workflows")).alias("workflow_all"), _share(c("met"), c("entities")).alias("entity_any"),
    )


def handle_audit(truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: coverage, distinct handles, and the shares of handles that recur, cross workflows, or belong to several labels; median requests a handle."""
    met = anchors.join(truth, "request_id")
    each = met.groupBy("anchor").agg(F.count_distinct("request_id").alias("requests"), F.count_distinct("workflow").alias("workflows"), F.count_distinct("label").alias("labels"))
    handles = each.agg(F.count("*").alias("handles"), *[_share(F.count_if(F.col(x) > 1), F.count("*")).alias(y) for x, y in (("requests", "recurrent"), ("workflows", "cross_workflow"), ("labels", "ambiguous"))], F.coalesce(F.median("requests"), F.lit(0.0)).alias("median_requests"))
    covered = truth.join(anchors.select("request_id").distinct().withColumn("hit", F.lit(1)), "request_id", "left").agg(F.count("*").alias("requests"), _share(F.count("hit"), F.count("*")).alias("coverage"))
    return covered.crossJoin(handles)  # two single rows


def anchor_statistics(rows: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per anchor type (the part before the value): how many anchors, how often and for how long each is seen, and how ambiguous it is.

    ``rows``: ``request_id``, ``ms``; ``anchors`` has ``kind`` besides.
    """
    day = 86_400_000.0
    met = anchors.join(rows.select("request_id", "ms"), "request_id").join(truth, "request_id", "left")
    each = met.groupBy("kind", "anchor").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct("workflow").alias("workflows"), F.coalesce((F.max("ms") - F.min("ms")) / day, F.lit(0.0)).alias("days"))
    return each.groupBy("kind").agg(
        F.count("*").alias("anchors"), F.median("n").alias("median_occurrences"), F.max("n").alias("max_occurrences"), _share(F.count_if(F.col("labels") > 1), F.count("*")).alias("ambiguous_share"), _share(F.count_if(F.col("workflows") > 1), F.count("*")).alias("cross_workflow_share"),
        F.round(F.median("days"), 9).alias("median_days"), F.round(F.max("days"), 9).alias("max_days"),
    )


def cost_model(requests: DataFrame, candidates: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: requests, all pairs, candidate pairs, pairs a request, how many times fewer than all; with measured ``seconds`` also seconds a thousand and CPU hours a million requests."""
    n = requests.agg(F.count("*").alias("requests"))
    m = candidates.agg(F.count("*").alias("candidate_pairs"))
    out = n.crossJoin(m).withColumn("all_pairs", (F.col("requests") * (F.col("requests") - 1) / 2).cast("long"))
    out = out.select("requests", "all_pairs", "candidate_pairs", F.round(_share(F.col("candidate_pairs"), F.col("requests")), 3).alias("pairs_per_request"), F.round(_share(F.col("all_pairs"), F.col("candidate_pairs")), 3).alias("reduction"))
    if seconds is not None:
        out = out.withColumns({"seconds_per_1k": F.round(_share(F.lit(seconds * 1000), F.col("requests")), 3), "cpu_hours_per_1m": F.round(_share(F.lit(seconds * 1e6 / 3600), F.col("requests")), 3)})
    return out


def stratified_split(rows: DataFrame, key: str, stratum: str, share: float, seed: int = 7) -> DataFrame:
    """Adds ``held_out``: of each stratum the ``share`` (rounded) of keys of smallest SHA-256; keys are distinct.

    Keys are numbered by range within the stratum, so a hot stratum is cut over
    many tasks.
    """
    drawn = rows.withColumn("draw", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256))
    placed = numbered(drawn, ["draw", key], [stratum])
    sizes = rows.groupBy(stratum).agg(F.bround(F.count("*") * F.lit(share)).cast("long").alias("cut"))
    return placed.join(sizes, stratum).withColumn("held_out", F.col("n") <= F.col("cut")).drop("draw", "n", "cut")


def interval_split(rows: DataFrame, key: str, share: float, seed: int = 7) -> DataFrame:
    """Adds ``held_out``: keys whose SHA-1, as a number of [0, 1), is below the share."""
    drawn = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key))), 1, 12), 16, 10).cast("double") / float(16**12)
    return rows.withColumn("held_out", drawn < share)


def consistent_tasks(rows: DataFrame, workflow: str, task: str) -> DataFrame:
    """``workflow`` and its base task (the trial's number cut off); workflows with several base tasks are left out."""
    base = F.regexp_replace(F.col(task), r":trial_[^:]+$", "")
    return rows.where(F.col(task).isNotNull()).groupBy(workflow).agg(F.min(base).alias("base_task"), F.max(base).alias("other")).where("base_task = other").drop("other")


def summary_pivot(metrics: DataFrame, key: str, column: str, values: list[str], measure: str) -> DataFrame:
    """One row a ``key``, with ``measure`` in a column for each of the stated values."""
    return metrics.groupBy(key).pivot(column, values).agg(F.first(measure, ignorenulls=True))


def risk_rollup(fields: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Sums of ``tp``, ``fp``, ``fn`` of profile fields by risk level, with precision, recall and F1; fields of no level are left out."""
    pairs = [F.struct(F.lit(level).alias("level"), F.lit(f).alias("field")) for level, fs in levels.items() for f in fs]
    named = fields.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    g = fields.join(F.broadcast(named), "field").groupBy("level").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])  # a few stated rows
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("level", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def scale_gate(numbers: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """One row of booleans: whether each number of a one-row table is within its bounds, and ``passed``: all of them."""

    def within(name: str, low: float | None, high: float | None) -> Column:
        tests = [F.col(name) >= low] * (low is not None) + [F.col(name) <= high] * (high is not None)
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    flags = {name: within(name, *b) for name, b in bounds.items()}
    return numbers.select(*[f.alias(name) for name, f in flags.items()], reduce(lambda a, b: a & b, flags.values(), F.lit(True)).alias("passed"))


def leading(rows: DataFrame, by: list[str], count: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value."""
    w = Window.partitionBy(*by[:-1]).orderBy(F.desc(count), by[-1])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
