"""Reconstruction of workflows from session labels, and how well their order holds.

``rows``: ``request_id``, ``ms``, ``messages``.  ``labels``: ``request_id``,
``label``.  Requests of a label are ordered by how many others of it are
predecessors (their whole list of messages begins this one's), then by minute,
length of text and id.  Predecessors are counted by an equi-join on digests of
message prefixes, so no pairs of a label's requests are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import prefix_digests
from ..scratch import Scratch
from .components import components
from .evaluation import ratio
from .requests import request_text


def prefixes(rows: DataFrame) -> DataFrame:
    """``request_id``, ``digest``, ``whole``: the digest of every prefix of the messages; of no messages that of nothing."""
    return rows.select("request_id", F.posexplode(prefix_digests(F.col("messages"))).alias("i", "digest"), F.greatest(F.lit(1), F.coalesce(F.size("messages"), F.lit(0))).alias("n")).select("request_id", "digest", (F.col("i") == F.col("n") - 1).alias("whole"))


def nesting_links(rows: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` of requests whose whole messages begin another one's: each with the first request of those messages (a star)."""
    p = Scratch(rows.sparkSession, "nesting").save(prefixes(rows), "prefixes")
    first = p.where("whole").groupBy("digest").agg(F.min("request_id").alias("first"))
    return p.join(first, "digest").where("request_id <> first").select(F.col("first").alias("u"), F.col("request_id").alias("v")).distinct()


def nesting_labels(rows: DataFrame) -> DataFrame:
    """``request_id``, ``label``: the components of nested requests, alone ones included."""
    found = components(nesting_links(rows), rows.select(F.col("request_id").alias("id")))
    return found.select(F.col("id").alias("request_id"), "label")


def ordered_requests(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``label``, ``request_id``, ``ms``, ``position`` (from 1) and ``predecessors`` of every labelled request."""
    own = Scratch(rows.sparkSession, "workflows").save(rows.join(labels, "request_id").select("label", "request_id", "ms", "messages", F.char_length(request_text(F.col("messages"))).alias("size")), "own")
    p = prefixes(own.select("request_id", "messages")).join(own.select("request_id", "label"), "request_id")
    held = p.where("whole").groupBy("label", "digest").agg(F.count("*").alias("n"))
    met = p.join(held, ["label", "digest"]).groupBy("request_id").agg((F.sum("n") - 1).alias("predecessors"))  # itself left out
    minute = F.floor(F.col("ms") / 60_000)
    w = Window.partitionBy("label").orderBy("predecessors", F.coalesce(minute, F.lit(-1)), "size", "request_id")
    return own.join(met, "request_id").select("label", "request_id", "ms", "predecessors", F.row_number().over(w).alias("position"))


def reconstruct(rows: DataFrame, labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a label: requests, first and last instant in its order, and against truth: the majority workflow, its share, and how often its turns are in order.

    ``truth``: ``request_id``, ``workflow``, ``turn``.  Pairs of turns are those
    of one workflow within one label, which its turns bound; ties of the
    majority go to the smaller name.
    """
    placed = Scratch(rows.sparkSession, "reconstruct").save(ordered_requests(rows, labels).join(truth, "request_id", "left"), "placed")
    whole = placed.groupBy("label").agg(F.count("*").alias("requests"), F.min_by("ms", "position").alias("start_ms"), F.max_by("ms", "position").alias("end_ms"))
    counted = placed.where("workflow is not null").groupBy("label", "workflow").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "workflow")
    major = counted.withColumn("r", F.row_number().over(w)).where("r = 1").select("label", "workflow", "n")
    own = placed.join(major.select("label", "workflow"), ["label", "workflow"]).select("label", "request_id", "turn", "position")
    turn_order = Window.partitionBy("label").orderBy("turn", "request_id")
    own = own.withColumn("t", F.row_number().over(turn_order)).withColumn("next", F.lead("position").over(turn_order))
    near = own.where("next is not null").groupBy("label").agg(F.avg((F.col("position") < F.col("next")).cast("double")).alias("adjacent"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.t") < F.col("b.t"))).groupBy(F.col("a.label").alias("label")).agg(F.avg((F.col("a.position") < F.col("b.position")).cast("double")).alias("pairwise"))
    out = whole.join(major, "label", "left").join(near, "label", "left").join(pairs, "label", "left")
    return out.select("label", "requests", "start_ms", "end_ms", F.col("workflow").alias("majority_workflow"), F.coalesce("n", F.lit(0)).alias("majority_requests"), F.coalesce(F.col("n") / F.col("requests"), F.lit(0.0)).alias("purity"), F.coalesce("pairwise", F.lit(0.0)).alias("pairwise_order"), F.coalesce("adjacent", F.lit(0.0)).alias("adjacent_order"))


def reconstruction_summary(workflows: DataFrame) -> DataFrame:
    """One row: workflows, requests, and the means of purity and order accuracies."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    return workflows.agg(F.count("*").alias("workflows"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), mean("purity"), mean("pairwise_order"), mean("adjacent_order"))


def candidate_stages(stages: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Of each stage's pairs (``left`` < ``right``), and of their union: how many, how many are true, recall and precision.

    ``truth``: ``request_id``, ``label``.  True pairs are counted by groups and
    never made; a stage's pairs meet truth by two joins.
    """
    every = None
    for name, pairs in stages.items():
        d = pairs.select(F.lit(name).alias("stage"), "left", "right").distinct()
        every = d if every is None else every.unionByName(d)
    every = Scratch(truth.sparkSession, "stages").save(every, "pairs")
    every = every.unionByName(every.select(F.lit("union").alias("stage"), "left", "right").distinct())
    side = lambda tag: truth.select(F.col("request_id").alias(tag), F.col("label").alias(f"{tag}_label"))
    met = every.join(side("left"), "left").join(side("right"), "right")
    counted = met.groupBy("stage").agg(F.count("*").alias("candidate_pairs"), F.count_if(F.col("left_label") == F.col("right_label")).alias("true_pairs"))
    total = truth.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long").alias("truth_pairs"))
    share = lambda a, b: ratio(F.col(a).cast("double"), F.col(b).cast("double"))
    return counted.crossJoin(total).select("stage", "candidate_pairs", "true_pairs", "truth_pairs", share("true_pairs", "truth_pairs").alias("recall"), share("true_pairs", "candidate_pairs").alias("precision"))


def threshold_sweep(scored: DataFrame, first: str, second: str, grid: list[tuple[float, float]], vertices: DataFrame, truth: DataFrame) -> DataFrame:
    """Pair metrics of the components at each pair of thresholds: ``first_least``, ``second_least``, linked pairs, clusters, precision, recall, F1.

    Pairs are scored once; all points of the grid are contracted together, the
    point being part of the vertex.
    """
    from .evaluation import evaluate_all

    points = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(i).alias("i")) for i, (a, b) in enumerate(grid)])).alias("g")
    linked = Scratch(scored.sparkSession, "sweep").save(scored.select("left", "right", first, second, points).where((F.col(first) >= F.col("g.a")) & (F.col(second) >= F.col("g.b"))).select("left", "right", "g.*"), "linked")
    key = lambda c: F.concat_ws("\t", F.col("i").cast("string"), F.col(c))
    every = vertices.select("request_id", points).select(F.concat_ws("\t", F.col("g.i").cast("string"), "request_id").alias("id"))
    found = components(linked.select(key("left").alias("u"), key("right").alias("v")), every)
    part = lambda c, n: F.split(c, "\t", 2)[n]
    labels = found.select(part("id", 0).cast("int").alias("i"), part("id", 1).alias("request_id"), "label")
    metrics = evaluate_all(labels, truth, ["i"])
    pairs = linked.groupBy("i").agg(F.count("*").alias("linked_pairs"))
    at = scored.sparkSession.range(1).select(points).select(F.col("g.i").alias("i"), F.col("g.a").alias("first_least"), F.col("g.b").alias("second_least"))
    return at.join(metrics, "i").join(pairs, "i", "left").select("first_least", "second_least", F.coalesce("linked_pairs", F.lit(0)).alias("linked_pairs"), "clusters", "precision", "recall", "f1")


def best_point(sweep: DataFrame, least_precision: float = 0.8) -> DataFrame:
    """The point of the sweep of best F1 among those of enough precision (else among all), ties by precision, recall and the higher thresholds."""
    order = [F.desc(F.col("precision") >= least_precision), F.desc("f1"), F.desc("precision"), F.desc("recall"), F.desc("first_least"), F.desc("second_least")]
    return sweep.orderBy(*order).limit(1)
