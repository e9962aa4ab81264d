"""Consolidating pairwise matches into groups.

Method: peel the giant component by frontier breadth-first joins from the
vertex of highest degree, anti-join it away, and label the remaining small
components by minimum propagation.

*Peel.*  The links are kept in both directions, written once in buckets of the
vertex they start from.  Each round joins the frontier with them and takes the
vertices not visited yet: a neighbour of the frontier is in the frontier, in
the one before it, or new, so only those two are anti-joined.  The search goes
on until its frontier is empty, whatever the size of the frontiers.

*Anti-join.*  All links of visited vertices are dropped; what is left has no
link with them.

*Propagate.*  Each round gives every vertex the smallest label among its own
and those of its neighbours.  Between rounds labels jump: a vertex takes the
label that the vertex named by its own label has, so a path of n vertices takes
about log n rounds and not n.  Labels only fall, and end at the smallest id of
the component.  Vertices whose neighbourhood is done are not looked at again:
only links with a label that fell go into the next round.

Every round is a table in the shared folder: lost executors cost no earlier
round, and plans stay short.  Counts come with the writes.  Nothing of the size
of the data is collected or broadcast; the driver sees counts, one hub and one
smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _clean(name: str) -> Column:
    t = F.trim(F.col(name).cast("string"))
    return F.when(t != "", t)


def match_links(pair_evidence: DataFrame, link_decision: DataFrame, least_score: float = 4.2) -> DataFrame:
    """Links (``u``, ``v``) of both tables that count as matches.

    Of ``pair_evidence`` rows with ``score >= least_score`` and no conflicts
    (null or empty); of ``link_decision`` rows accepted with a predecessor.
    """
    a = pair_evidence.where((F.col("score") >= least_score) & (F.coalesce(F.size("conflicts"), F.lit(0)) <= 0)).select(_clean("earlier_id").alias("u"), _clean("later_id").alias("v"))
    b = link_decision.where(F.col("disposition") == "accept").select(_clean("request_id").alias("u"), _clean("predecessor_id").alias("v"))
    return a.unionByName(b)


def _peel(links: DataFrame, hub: str, scratch: Scratch) -> DataFrame:
    """The vertices (``u``) of the component of ``hub``, by breadth-first search until the frontier is empty.

    The levels are folders of one table, so the visited are read as one.  The
    rounds are as many as the steps to the vertex farthest from the hub.
    """
    front = scratch.save(links.sparkSession.createDataFrame([(hub,)], "u string"), "visited/level=0")
    before, n, k = front.limit(0), 1, 0
    while n:
        k += 1
        reached = links.join(front, "u", "left_semi").select(F.col("v").alias("u")).distinct()
        fresh = reached.join(front.unionByName(before), "u", "left_anti")
        before = front
        front, n = scratch.save_counted(fresh, f"visited/level={k}")
    return links.sparkSession.read.schema("u string").parquet(scratch.path("visited"))


def _propagate(links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``u``, ``label``: the smallest id of the component of every vertex of ``links`` (both directions); None without links."""
    labels, n = scratch.save_counted(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumn("fell", F.lit(True)), "labels0")
    if not n:
        return None
    k = 0
    while True:
        k += 1
        # from every vertex whose label fell to its neighbours; the neighbour's smallest offer
        moved = labels.where("fell").select("u", "label")
        offers = links.join(moved, "u").groupBy(F.col("v").alias("u")).agg(F.min("label").alias("offer"))
        # what the vertex named by the label has by now
        named = labels.select(F.col("u").alias("label"), F.col("label").alias("jump"))
        both = labels.join(offers, "u", "left").join(named, "label", "left")
        least = F.least("label", F.coalesce("offer", "label"), F.coalesce("jump", "label"))
        labels, fell = scratch.save_counted(both.select("u", least.alias("label"), (least < F.col("label")).alias("fell")), f"labels{k}", "fell")
        scratch.drop(f"labels{k - 1}")
        if not fell:
            return labels.select("u", "label")


def connected_components(links: DataFrame, src: str = "u", dst: str = "v", id_col: str = "request_id", group_col: str = "group_id") -> DataFrame:
    """One row per vertex that is linked to another one: its id and the smallest id of its group.

    Links are undirected, may repeat, be swapped, or be null or a self pair
    (both ignored).  Ids are compared as strings, byte by byte.  An empty table
    gives an empty result.  Other columns of ``links`` are ignored.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(src).cast("string").alias("u"), F.col(dst).cast("string").alias("v")).where("u <> v")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = scratch.save(both, "edges")
    hub = edges.groupBy("u").count().orderBy(F.desc("count"), "u").select("u").head()
    if hub is None:
        return edges.select(F.col("u").alias(id_col), F.col("v").alias(group_col))
    giant = _peel(edges, hub["u"], scratch)
    # the giant group's smallest id is one value, so its members need no join on a hot key
    least = giant.agg(F.min("u").alias("least")).head()["least"]
    out = giant.select(F.col("u").alias(id_col), F.lit(least).alias(group_col))
    rest = scratch.save(edges.join(giant, "u", "left_anti"), "rest")
    small = _propagate(rest, scratch)
    return out if small is None else out.unionByName(small.select(F.col("u").alias(id_col), F.col("label").alias(group_col)))
