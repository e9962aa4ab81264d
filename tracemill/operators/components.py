"""Connected components by contraction along the smallest neighbour.

Each round sends every vertex to the smallest vertex, in a random but fixed
order, among itself and its neighbours, moves the edges along and drops loops
and doubles.  Connectivity stays, and any graph, long paths included, shrinks
by a constant factor a round in expectation.  The rounds' maps are composed at
the end.  All state is in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``id``, ``label``: a representative of the component of every vertex of ``edges`` (u < v, distinct); None without edges."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    maps: list[DataFrame] = []
    current = scratch.save(edges, "contract0")
    while current.head(1):
        n = len(maps)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min(rank("v")).alias("least")).select("u", F.least(F.col("least"), rank("u")).getField("id").alias("to"))
        m = scratch.save(to, f"map{n}")
        maps.append(m)
        moved = current.join(m.select("u", F.col("to").alias("a")), "u").join(m.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").where("a <> b")
        current = scratch.save(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"contract{n + 1}")
        scratch.drop(f"contract{n}")
    if not maps:
        return None
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        whole = m.join(whole.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("u", F.coalesce("end", "to").alias("to"))
    return scratch.save(whole.select(F.col("u").alias("id"), F.col("to").alias("label")), "labels")


def components(links: DataFrame, vertices: DataFrame | None = None, src: str = "u", dst: str = "v") -> DataFrame:
    """``id``, ``label`` (the smallest id of the component).

    Links are undirected; nulls and self links are ignored, repeats count once.
    With ``vertices`` (a column ``id``) every vertex comes out, unlinked ones as
    their own component; links to ids that are no vertices still connect.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(src).cast("string").alias("u"), F.col(dst).cast("string").alias("v")).where("u <> v")
    found = contract(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), scratch)
    if found is None:
        if vertices is None:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("label"))
        return vertices.select("id", F.col("id").alias("label")).distinct()
    least = found.groupBy("label").agg(F.min("id").alias("least"))
    named = found.join(least, "label").select("id", F.col("least").alias("label"))
    if vertices is None:
        return named
    return vertices.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
