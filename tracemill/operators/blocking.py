"""Blocking: postings, capped buckets, candidate pairs and star edges.

A *posting* is a row ``block``, ``value``, ``id``.  Buckets (block, value) are
counted before anything is joined, so an oversized or hot value never reaches
a join: it is dropped where a cap is the operator's rule, and linked as a star
(linear in its size) where every member counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def postings(features: DataFrame, values: Column, block: Column | None = None, id_col: str = "request_id") -> DataFrame:
    """One row per id and distinct value; null or empty arrays give none."""
    return features.select(F.coalesce(block.cast("string"), F.lit("")).alias("block") if block is not None else F.lit("").alias("block"), F.col(id_col).alias("id"), F.explode(F.array_distinct(values)).alias("value")).where("value is not null")


def bucket_sizes(posted: DataFrame) -> DataFrame:
    return posted.groupBy("block", "value").agg(F.count("*").alias("size"), F.min("id").alias("first"))


def capped(posted: DataFrame, cap: int) -> DataFrame:
    """Postings of buckets of 2 to ``cap`` members, with ``size`` and ``first`` (the smallest member)."""
    return posted.join(bucket_sizes(posted).where((F.col("size") > 1) & (F.col("size") <= cap)), ["block", "value"])


def star_edges(posted: DataFrame, cap: int | None = None) -> DataFrame:
    """Links of every member of a bucket with its smallest member: ``u``, ``v``; linear in the postings."""
    sizes = bucket_sizes(posted).where("size > 1")
    if cap is not None:
        sizes = sizes.where(F.col("size") <= cap)
    return posted.join(sizes, ["block", "value"]).where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()


def member_sets(posted: DataFrame, cap: int) -> DataFrame:
    """Distinct sets of members of the buckets of 2 to ``cap``: ``block``, ``members`` (sorted), ``size``, ``first``, ``value`` (the smallest of its values) and ``values`` (how many).

    Cumulative requests put the same members into thousands of buckets; each
    set is expanded to pairs once.  Oversized buckets are dropped before
    anything is collected, so a list has at most ``cap`` members.
    """
    listed = capped(posted, cap).groupBy("block", "value").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return listed.groupBy("block", "members").agg(F.min("value").alias("value"), F.count("*").alias("values")).select("block", "members", F.size("members").cast("long").alias("size"), F.col("members")[0].alias("first"), "value", "values")


def _expanded(sets: DataFrame, *carry: str) -> DataFrame:
    """All pairs ``left`` < ``right`` of each set."""
    later = lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.struct(x.alias("left"), y.alias("right")))
    return sets.select("block", *carry, F.explode(F.flatten(F.transform("members", later))).alias("p")).select("block", *carry, "p.left", "p.right")


def candidate_pairs(posted: DataFrame, cap: int, rest: bool = False) -> DataFrame:
    """Distinct pairs ``block``, ``left`` < ``right`` of members of capped buckets, with ``shared`` values.

    A bucket gives at most cap*(cap-1)/2 pairs, so the work is linear in the
    postings for a given cap.  With ``rest`` the members of larger buckets
    come out too, each with the bucket's smallest member (a representative and
    its membership, linear in the bucket), so no link is lost to the cap.
    """
    pairs = _expanded(member_sets(posted, cap), "values")
    if rest:
        big = posted.join(bucket_sizes(posted).where(F.col("size") > cap), ["block", "value"]).where("id <> first")
        pairs = pairs.unionByName(big.select("block", F.lit(1).cast("long").alias("values"), F.col("first").alias("left"), F.col("id").alias("right")))
    return pairs.groupBy("block", "left", "right").agg(F.sum("values").alias("shared"))


def bounded_pairs(posted: DataFrame, cap: int, budget: int) -> DataFrame:
    """Candidate pairs such that no id is in more than ``budget`` of them.

    The rule is greedy: buckets by size, then smallest member, then value;
    pairs of a bucket in order; a pair counts if both ends have budget left.
    Where no id has more candidates than the budget, all pairs count, and
    nothing but a count decides that.  Elsewhere pairs are decided in rounds,
    by shuffles alone: a pair is in once the pairs before it at both ends, the
    undecided ones included, leave it budget, and out once those that are in
    leave it none at one end.  The first undecided pair is always decided, so
    the rounds end, with the result of the walk in order.
    """
    scratch = Scratch(posted.sparkSession, "bounded")
    pairs = _expanded(member_sets(posted, cap), "size", "first", "value").groupBy("block", "left", "right").agg(F.min(F.struct("size", "first", "value")).alias("place"))
    pairs = scratch.save(pairs, "pairs")

    def ends(df: DataFrame, *carry: str) -> DataFrame:
        return df.select("block", F.explode(F.array("left", "right")).alias("id"), "left", "right", *carry)

    degrees = ends(pairs).groupBy("block", "id").count()
    over = scratch.save(degrees.where(F.col("count") > budget).select("block", "id"), "over")
    keys = ["block", "left", "right"]
    if not over.head(1):
        return pairs.select(*keys)
    state, chosen, k = pairs.withColumn("taken", F.lit(None).cast("boolean")), [], 0
    while True:
        # only pairs at an id that is still open take part; the others are as they are
        at_open = ends(state).join(over, ["block", "id"], "left_semi").select(*keys).distinct()
        chosen.append(state.join(at_open, keys, "left_anti").where(F.coalesce("taken", F.lit(True))).select(*keys))
        w = Window.partitionBy("block", "id").orderBy("place", "left", "right").rowsBetween(Window.unboundedPreceding, -1)
        count = lambda c: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
        each = ends(state.join(at_open, keys, "left_semi"), "place", "taken")
        each = each.select("*", count(F.coalesce("taken", F.lit(False))).alias("sure"), count(F.coalesce("taken", F.lit(True))).alias("most"))
        seen = each.groupBy(*keys).agg(F.first("place").alias("place"), F.first("taken").alias("was"), F.max("sure").alias("sure"), F.max("most").alias("most"))
        verdict = F.coalesce("was", F.when(F.col("sure") >= budget, False).when(F.col("most") < budget, True))
        state = scratch.save(seen.select(*keys, "place", verdict.alias("taken")), f"round{k}")
        over = scratch.save(ends(state.where("taken is null")).select("block", "id").distinct(), f"open{k}")
        k += 1
        if not over.head(1):
            chosen.append(state.where("taken").select(*keys))
            return reduce(DataFrame.unionByName, chosen)


def anchor_pairs(posted: DataFrame, cap: int, rest: bool = False) -> DataFrame:
    """Pairs with the sorted anchors that they share; with ``rest`` members of larger buckets with the smallest one, as in ``candidate_pairs``."""
    kept = capped(posted, cap)
    listed = kept.groupBy("block", "value").agg(F.array_sort(F.collect_list("id")).alias("members"))
    pairs = _expanded(listed, "value")
    if rest:
        big = posted.join(bucket_sizes(posted).where(F.col("size") > cap), ["block", "value"]).where("id <> first")
        pairs = pairs.unionByName(big.select("block", "value", F.col("first").alias("left"), F.col("id").alias("right")))
    return pairs.groupBy("left", "right").agg(F.array_sort(F.collect_set("value")).alias("anchors"))


def sketch_bands(hashes: Column, size: int = 32, bands: int = 8) -> Column:
    """Bands of the ``size`` smallest hashes, as labelled strings; an incomplete last band is left out."""
    rows = size // bands
    least = F.slice(F.array_sort(F.array_distinct(hashes)), 1, size)
    band = lambda b: F.when(F.size(least) >= (b + 1) * rows, F.concat(F.lit(f"{b}:"), F.array_join(F.transform(F.slice(least, b * rows + 1, rows), lambda h: h.cast("string")), ",")))
    return F.array_compact(F.array(*[band(b) for b in range(bands)]))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
