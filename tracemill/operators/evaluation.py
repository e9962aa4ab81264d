"""Cluster, selection, ordering and distribution metrics.

All pair metrics are counts of groups, never enumerated pairs.  A ratio with
an empty denominator is 0.  ``pred`` and ``truth`` have ``request_id`` and
``label``, one row per id; ids in only one of them are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum


def pairs_of(n: Column) -> Column:
    """Number of pairs of n things."""
    return n * (n - 1) / 2


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _both(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return pred.select("request_id", F.col("label").alias("p")).join(truth.select("request_id", F.col("label").alias("t")), "request_id")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def clustering_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: items, clusters, pairwise precision, recall and F1, purity, split and merge rate."""
    cells = _both(pred, truth).groupBy("p", "t").agg(F.count("*").alias("n"))
    by_p = cells.groupBy("p").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("k"))
    by_t = cells.groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    a = cells.agg(_sum(pairs_of(F.col("n"))).alias("hits"))
    b = by_p.agg(_sum(pairs_of(F.col("n"))).alias("predicted"), F.count("*").alias("clusters"), _sum(F.col("n")).alias("items"), _sum(F.col("most")).alias("most"), _sum((F.col("k") > 1).cast("int")).alias("merged"))
    c = by_t.agg(_sum(pairs_of(F.col("n"))).alias("positive"), F.count("*").alias("truths"), _sum((F.col("k") > 1).cast("int")).alias("split"))
    one = a.crossJoin(b).crossJoin(c)  # three single rows
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("positive"))
    return one.select(
        F.col("items").cast("long").alias("items"), "clusters", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("most"), F.col("items")).alias("purity"), ratio(F.col("split"), F.col("truths")).alias("split_rate"), ratio(F.col("merged"), F.col("clusters")).alias("merge_rate")
    )


def pair_confusion(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: items, all pairs, and the four cells of the pair confusion."""
    cells = _both(pred, truth).groupBy("p", "t").agg(F.count("*").alias("n"))
    a = cells.agg(_sum(pairs_of(F.col("n"))).alias("tp"), _sum(F.col("n")).alias("items"))
    b = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(_sum(pairs_of(F.col("n"))).alias("predicted"))
    c = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(_sum(pairs_of(F.col("n"))).alias("positive"))
    one = a.crossJoin(b).crossJoin(c)
    total = pairs_of(F.col("items"))
    cells_ = {"items": F.col("items"), "total_pairs": total, "tp": F.col("tp"), "fp": F.col("predicted") - F.col("tp"), "fn": F.col("positive") - F.col("tp"), "tn": total - F.col("predicted") - F.col("positive") + F.col("tp")}
    return one.select(*[c.cast("long").alias(k) for k, c in cells_.items()])


def cross_workflow_metrics(pred: DataFrame, truth: DataFrame, workflow: DataFrame) -> DataFrame:
    """Pair metrics over pairs of different workflows: all pairs less those within a workflow."""
    rows = _both(pred, truth).join(workflow.select("request_id", F.col("label").alias("w")), "request_id")
    cube = rows.groupBy("p", "t", "w").agg(F.count("*").alias("n"))

    def pairs(*keys: str) -> DataFrame:
        name = "".join(keys)
        return cube.groupBy(*keys).agg(F.sum("n").alias("n")).agg(_sum(pairs_of(F.col("n"))).alias(name))

    one = pairs("p", "t").crossJoin(pairs("p", "t", "w")).crossJoin(pairs("p")).crossJoin(pairs("p", "w")).crossJoin(pairs("t")).crossJoin(pairs("t", "w"))
    hits, predicted, positive = F.col("pt") - F.col("ptw"), F.col("p") - F.col("pw"), F.col("t") - F.col("tw")
    p, r = ratio(hits, predicted), ratio(hits, positive)
    return one.select(hits.cast("long").alias("tp"), predicted.cast("long").alias("predicted_pairs"), positive.cast("long").alias("truth_pairs"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def evaluate_all(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise metrics by ``keys`` (of both tables, such as method and level), in one plan."""
    rows = pred.select(*keys, "request_id", F.col("label").alias("p")).join(truth.select(*[k for k in keys if k in truth.columns], "request_id", F.col("label").alias("t")), [*[k for k in keys if k in truth.columns], "request_id"])
    cells = rows.groupBy(*keys, "p", "t").agg(F.count("*").alias("n"))
    a = cells.groupBy(*keys).agg(_sum(pairs_of(F.col("n"))).alias("hits"), F.sum("n").alias("items"))
    b = cells.groupBy(*keys, "p").agg(F.sum("n").alias("n")).groupBy(*keys).agg(_sum(pairs_of(F.col("n"))).alias("predicted"), F.count("*").alias("clusters"))
    c = cells.groupBy(*keys, "t").agg(F.sum("n").alias("n")).groupBy(*keys).agg(_sum(pairs_of(F.col("n"))).alias("positive"))
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("positive"))
    return a.join(b, keys).join(c, keys).select(*keys, "items", "clusters", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def false_merges(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: clusters of several truths, requests in them, false pairs, and the fewest wrong links that explain them."""
    cells = _both(pred, truth).groupBy("p", "t").agg(F.count("*").alias("n"))
    each = cells.groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(pairs_of(F.col("n"))).alias("good")).where("k > 1")
    bridges = _sum(F.col("k") - 1)
    wrong = _sum(pairs_of(F.col("n")) - F.col("good"))
    return each.agg(F.count("*").alias("mixed_clusters"), _sum(F.col("n")).cast("long").alias("contaminated"), wrong.cast("long").alias("false_pairs"), bridges.cast("long").alias("bridges"), ratio(wrong, bridges).alias("amplification"))


def cost_ratios(pred: DataFrame, truth: DataFrame, ratios: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """Weighted cost of wrong links against missed ones, at several weights, and false links per million negatives."""
    c = pair_confusion(pred, truth)
    negative = F.col("fp") + F.col("tn")
    return c.select("*", F.explode(F.array(*map(F.lit, ratios))).alias("weight")).select("weight", "fp", "fn", (F.col("weight") * F.col("fp") + F.col("fn")).alias("cost"), ratio(F.col("fp") * 1e6, negative).alias("false_per_million"))


def selective_metrics(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: decisions, coverage, precision of accepted links (both ends with the same label), rejected and abstained shares."""
    t = truth.select("request_id", F.col("label").alias("own"))
    other = truth.select(F.col("request_id").alias("predecessor_id"), F.col("label").alias("theirs"))
    rows = decisions.join(t, "request_id").join(other, "predecessor_id", "left")
    accepted = (F.col("disposition") == "accept") & F.col("predecessor_id").isNotNull()
    right = accepted & (F.col("own") == F.col("theirs"))
    n, a = F.count("*"), _sum(accepted.cast("int"))
    return rows.agg(
        n.alias("decisions"), a.cast("long").alias("accepted"), ratio(_sum(F.coalesce(right, F.lit(False)).cast("int")), a).alias("precision"), ratio(a, n.cast("double")).alias("coverage"), ratio(_sum((F.col("disposition") == "reject").cast("int")), n.cast("double")).alias("rejected_share"), ratio(_sum((F.col("disposition") == "abstain").cast("int")), n.cast("double")).alias("abstained_share")
    )


def risk_coverage(decisions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision and coverage of accepted links of at least each score; thresholds are a short list, so rows are spread once."""
    t = truth.select("request_id", F.col("label").alias("own"))
    other = truth.select(F.col("request_id").alias("predecessor_id"), F.col("label").alias("theirs"))
    rows = decisions.join(t, "request_id").join(other, "predecessor_id", "left")
    spread = rows.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = (F.col("disposition") == "accept") & F.col("predecessor_id").isNotNull() & (F.col("score") >= F.col("threshold"))
    a = _sum(F.coalesce(hit, F.lit(False)).cast("int"))
    good = _sum(F.coalesce(hit & (F.col("own") == F.col("theirs")), F.lit(False)).cast("int"))
    return spread.groupBy("threshold").agg(a.cast("long").alias("accepted"), ratio(good, a).alias("precision"), ratio(a, F.count("*").cast("double")).alias("coverage"))


def ordering_accuracy(rows: DataFrame, group: str, truth_order: str, by: list[str]) -> DataFrame:
    """How often an order by ``by`` agrees with ``truth_order`` within groups: neighbouring and all pairs.

    All pairs are counted from ranks (inversions by a self-join within a group
    would be quadratic): a pair agrees if both orders rank it alike, which is
    counted by a band join on equal groups with the truth rank below.  Groups
    are workflows, whose size is bounded by their turns.
    """
    w = Window.partitionBy(group).orderBy(*by)
    ranked = rows.select(group, "request_id", F.col(truth_order).alias("turn"), F.row_number().over(w).alias("rank"))
    nxt = F.lead("turn").over(Window.partitionBy(group).orderBy("rank"))
    adjacent = ranked.withColumn("next", nxt).where("next is not null").agg(F.count("*").alias("adjacent_pairs"), _sum((F.col("next") >= F.col("turn")).cast("int")).alias("adjacent_right"))
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.turn") < F.col("b.turn")))
    every = pairs.agg(F.count("*").alias("ordered_pairs"), _sum((F.col("a.rank") < F.col("b.rank")).cast("int")).alias("pairs_right"))
    return adjacent.crossJoin(every).select("adjacent_pairs", "ordered_pairs", ratio(F.col("adjacent_right"), F.col("adjacent_pairs").cast("double")).alias("adjacent_accuracy"), ratio(F.col("pairs_right"), F.col("ordered_pairs").cast("double")).alias("pairwise_accuracy"))


def equivalence_bound(k: Column, m: Column) -> tuple[Column, Column]:
    """Best pair precision and F1 when k truths of m items each look alike."""
    p = ratio((m - 1).cast("double"), (k * m - 1).cast("double"))
    return p, ratio(2 * p, 1 + p)


def js_divergence(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon divergence (bits) of a categorical column of two tables."""
    pa_ = a.groupBy(column).agg(F.count("*").alias("n"))
    pb_ = b.groupBy(column).agg(F.count("*").alias("m"))
    ta, tb = pa_.agg(F.sum("n").alias("tn")), pb_.agg(F.sum("m").alias("tm"))
    both = pa_.join(pb_, pa_[column].eqNullSafe(pb_[column]), "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")).crossJoin(ta).crossJoin(tb)
    p, q = F.col("n") / F.col("tn"), F.col("m") / F.col("tm")
    mid = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    return both.agg(F.coalesce(F.sum((part(p) + part(q)) / 2), F.lit(0.0)).alias("js_divergence"))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Largest distance of the two distribution functions of a numeric column.

    Values are aggregated first; the running sums then go over distinct values.
    The range is cut into ordered pieces whose totals are summed up, so the
    running sum isn't held by one task.
    """
    u = a.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))).where("v is not null")
    each = u.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = each.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    run = running_sum(running_sum(each, ["v"], [], "x", "cx"), ["v"], [], "y", "cy")
    return run.crossJoin(total).agg(F.coalesce(F.max(F.abs(F.col("cx") / F.col("tx") - F.col("cy") / F.col("ty"))), F.lit(0.0)).alias("ks_statistic"))


#: Distribution function of Poisson(1) at 0, 1, ...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap_f1(pred: DataFrame, truth: DataFrame, unit: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Pairwise F1 of resampled units, by iteration.

    A unit's weight is Poisson(1) drawn from a hash of unit, iteration and
    seed, so a resample is the same in every run and needs no collected list.
    Pairs of a unit's own copies are taken out: from each sum of weighted pairs
    those of a request with itself and those of one unit's copies among
    themselves.
    """
    rows = _both(pred, truth).join(unit.select("request_id", F.col("label").alias("u")), "request_id")
    cells = rows.groupBy("p", "t", "u").agg(F.count("*").alias("n"))
    units = rows.select("u").distinct().select("u", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    drawn_from = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("u"), F.col("iteration").cast("string")), 256)
    draw = F.conv(F.substring(drawn_from, 1, 12), 16, 10).cast("double") / float(16**12)
    # inverse of the Poisson(1) distribution function
    weight = sum((F.when(draw > s, 1).otherwise(0) for s in POISSON[1:]), F.when(draw > POISSON[0], 1).otherwise(0))
    drawn = units.withColumn("w", weight).where("w > 0")
    each = cells.join(drawn, "u")

    def pairs(*keys: str) -> DataFrame:
        name = "".join(keys)
        whole = each.groupBy("iteration", *keys).agg(F.sum(F.col("n") * F.col("w")).alias("s"), F.sum(F.col("n") * pairs_of(F.col("w"))).alias("own"))
        part = each.groupBy("iteration", *keys, "u").agg(F.sum("n").alias("n"), F.max("w").alias("w")).groupBy("iteration").agg(F.sum((F.col("w") * F.col("w") - F.col("w")) * pairs_of(F.col("n"))).alias("copies"))
        return whole.groupBy("iteration").agg((F.sum(pairs_of(F.col("s"))) - F.sum("own")).alias("pairs")).join(part, "iteration").select("iteration", (F.col("pairs") - F.col("copies")).alias(name))

    one = pairs("p", "t").join(pairs("p"), "iteration").join(pairs("t"), "iteration")
    p, r = ratio(F.col("pt"), F.col("p")), ratio(F.col("pt"), F.col("t"))
    return one.select("iteration", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def paired_bootstrap(left: DataFrame, right: DataFrame, truth: DataFrame, unit: DataFrame, iterations: int, seed: int, level: float = 0.95) -> DataFrame:
    """One row: F1 of two predictions over the same resamples, the interval of their difference, and the share of resamples where the left one is ahead."""
    a = bootstrap_f1(left, truth, unit, iterations, seed).select("iteration", F.col("f1").alias("a"))
    b = bootstrap_f1(right, truth, unit, iterations, seed).select("iteration", F.col("f1").alias("b"))
    d = a.join(b, "iteration").withColumn("d", F.col("a") - F.col("b"))
    tail = (1 - level) / 2
    return d.agg(F.avg("a").alias("left_f1"), F.avg("b").alias("right_f1"), F.avg("d").alias("difference"), F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("left_ahead"))


def weighted_cross_f1(pred: DataFrame, truth: DataFrame, workflow: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: F1 over pairs of different workflows, each request with its weight (0 leaves it out).

    The weight of a pair is the product of those of its ends, so a group's pairs
    are (square of the sum - sum of the squares) / 2; pairs within a workflow
    are taken out in the same way.  ``weights``: ``request_id``, ``weight``.
    """
    rows = _both(pred, truth).join(workflow.select("request_id", F.col("label").alias("w")), "request_id").join(weights, "request_id")

    def pairs(*keys: str) -> DataFrame:
        g = rows.groupBy(*keys).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
        return g.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0)).alias("".join(keys)))

    one = pairs("p", "t").crossJoin(pairs("p", "t", "w")).crossJoin(pairs("p")).crossJoin(pairs("p", "w")).crossJoin(pairs("t")).crossJoin(pairs("t", "w"))  # single rows
    hits, predicted, positive = F.col("pt") - F.col("ptw"), F.col("p") - F.col("pw"), F.col("t") - F.col("tw")
    p, r = ratio(hits, predicted), ratio(hits, positive)
    return one.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def confidence_interval(samples: DataFrame, column: str = "f1", level: float = 0.95) -> DataFrame:
    """Mean and the two quantiles (by linear interpolation) of a sampled metric."""
    tail = (1 - level) / 2
    return samples.agg(F.avg(column).alias("mean"), F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1 - tail)).alias("high"), F.count("*").alias("iterations"))
