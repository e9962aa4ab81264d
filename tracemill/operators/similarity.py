"""Dense similarity: exact top-k, mutual neighbours and thresholds (an index is in ``encoders``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..ship import ship

#: Vectors of a block; a pair of blocks is multiplied by one call.
BLOCK = 2048


def unit(v: Column) -> Column:
    """The vector over its length, in doubles; a zero vector stays zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """Rows packed into blocks of about ``size``: ``ids`` and ``flat`` (all vectors in a row)."""
    n = F.spark_partition_id()
    numbered = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), unit(F.col(vec_col)).alias("v")).withColumn("part", n)
    w = F.floor(F.monotonically_increasing_id() % F.lit(1 << 33) / size)
    return numbered.withColumn("block", w).groupBy("part", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"))


def top_k_cosine(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", least: float = -2.0) -> DataFrame:
    """The k most similar rows of each query (itself left out): ``query_id``, ``id``, ``score``, ``rank``.

    A stated query set goes against all rows, in blocks: both sides are packed
    into blocks, each pair of blocks is one matrix product that keeps the k
    best of each query, and the blocks' bests are ranked at the end.  Ties go
    to the smaller id.  Null vectors are left out.
    """
    ship(vectors.sparkSession)
    base = _blocks(vectors, id_col, vec_col, BLOCK)
    asked = _blocks(queries, id_col, vec_col, BLOCK).select(F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i: np.asarray(batch.column(name)[i].values)
                ids, q_ids = get("ids"), get("q_ids")
                if not len(ids) or not len(q_ids):
                    continue
                s = get("q_flat").reshape(len(q_ids), -1) @ get("flat").reshape(len(ids), -1).T
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                s[s < least] = -np.inf
                m = min(k, len(ids))
                # ties at the cut must keep the smallest ids: order by score, then id
                order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 12)), axis=1)[:, :m]
                rows = np.repeat(np.arange(len(q_ids)), m)
                cols = order.ravel()
                score = s[rows, cols]
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows[keep]]), pa.array(ids[cols[keep]]), pa.array(score[keep])], names=["query_id", "id", "score"])

    # each side's blocks meet once: a stated query set against all rows, in blocks
    met = base.crossJoin(asked).mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _leading(top: DataFrame, margin: float) -> DataFrame:
    """The first of each query where it is ahead of the second by ``margin``."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return top.withColumn("second", F.lead("score").over(w)).where("rank = 1").where(F.col("score") - F.coalesce("second", F.lit(-1.0)) >= margin).select("query_id", "id", "score")


def mutual_neighbours(top: DataFrame, margin: float = 0.0) -> DataFrame:
    """Pairs that are each other's first, ahead of the second by ``margin``: ``left`` < ``right``, ``score``."""
    best = _leading(top, margin)
    back = best.select(F.col("query_id").alias("id"), F.col("id").alias("query_id"))
    return best.join(back, ["query_id", "id"]).where("query_id < id").select(F.col("query_id").alias("left"), F.col("id").alias("right"), "score")


def mutual_among_all(vectors: DataFrame, queries: DataFrame, margin: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Mutual neighbours, among all rows, of a stated query set: ``left`` < ``right``, ``score``.

    The best two of each query are looked for among all rows, and from the
    partners found the search goes back over all rows, so nearest, runner-up
    and margin are those of the whole table on both sides.
    """
    scratch = Scratch(vectors.sparkSession, "mutual")
    best = scratch.save(_leading(top_k_cosine(vectors, queries, 2, id_col, vec_col), margin), "best")
    partners = vectors.join(best.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    back = _leading(top_k_cosine(vectors, partners, 2, id_col, vec_col), margin).select(F.col("query_id").alias("id"), F.col("id").alias("query_id"))
    both = best.join(back, ["query_id", "id"])
    return both.select(F.least("query_id", "id").alias("left"), F.greatest("query_id", "id").alias("right"), F.round("score", 12).alias("score")).dropDuplicates(["left", "right"])


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Places of links of a spanning forest of the links u, v over n vertices."""
    root, kept = np.arange(n), []
    while True:
        a, b = root[u], root[v]
        live = np.flatnonzero(a != b)
        if not len(live):
            return np.concatenate(kept) if kept else live
        high, at = np.unique(np.maximum(a, b)[live], return_index=True)
        kept.append(live[at])
        root[high] = np.minimum(a, b)[live[at]]
        while (root[root] != root).any():
            root = root[root]


def threshold_links(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links ``u``, ``v`` with the components of the graph of all pairs of rows whose cosine is at least ``least``.

    Every row meets every other one, in blocks, with no cap on partners.  Each
    two blocks give a spanning forest of their links: the components stay, and
    the links are at most as many as the rows of both blocks.
    """
    blocks = Scratch(vectors.sparkSession, "threshold").save(_blocks(vectors, id_col, vec_col, BLOCK), "blocks")
    other = blocks.select(F.col("ids").alias("o_ids"), F.col("flat").alias("o_flat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i: np.asarray(batch.column(name)[i].values)
                ids, o_ids = get("ids"), get("o_ids")
                s = get("flat").reshape(len(ids), -1) @ get("o_flat").reshape(len(o_ids), -1).T
                rows, cols = np.nonzero(s >= least)
                # in one numbering, so that a row of both blocks is one vertex
                both, at = np.unique(np.concatenate([ids, o_ids]), return_inverse=True)
                keep = _forest(at[rows], at[len(ids) + cols], len(both))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[keep]]), pa.array(o_ids[cols[keep]])], names=["u", "v"])

    return blocks.join(other, blocks["ids"][0] <= other["o_ids"][0]).mapInArrow(run, "u long, v long")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("recall"))
