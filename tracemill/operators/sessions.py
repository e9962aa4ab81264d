"""Sessions: runs of events of one stream without a longer gap.

Secondary sort by range partitioning on (keys, time): a hot stream is cut by
time over as many partitions as its size asks for, so no task holds a whole
stream.  Each partition is scanned once, in order, in constant memory (one
Arrow batch and the open session).  Only the first and the last session of a
partition can go on in a neighbour; those (two a partition) are joined in a
second, tiny pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import instant_millis
from ..functions.labels import bucket_or_unavailable, present
from ..scratch import Scratch


def _changed(column: pa.Array) -> np.ndarray:
    """True at i where value i+1 differs from value i (nulls are equal)."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _scan(keys: list[str], gap_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open session: (key values, start, end, n)
        first = True

        def emit(rows: list[tuple], edges: list[bool]) -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in rows], pa.string()) for i in range(len(keys))]
            for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64())):
                columns.append(pa.array([r[k] for r in rows], kind))
            return pa.RecordBatch.from_arrays([*columns, pa.array(edges, pa.bool_())], names=[*keys, "start_ms", "end_ms", "n", "edge"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.column("ms").to_numpy(zero_copy_only=False)
            cut = np.diff(at) > gap_ms
            for k in keys:
                cut |= _changed(batch.column(k))
            starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
            ends = np.concatenate([starts[1:], [n]])
            values = [batch.column(k).take(pa.array(starts)).to_pylist() for k in keys]
            rows, edges = [], []
            for j, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                key = tuple(v[j] for v in values)
                piece = (key, int(at[a]), int(at[b - 1]), b - a)
                if held and held[0] == key and piece[1] - held[2] <= gap_ms:
                    held = (key, held[1], piece[2], held[3] + piece[3])
                    continue
                if held:
                    rows.append(held)
                    edges.append(first)
                    first = False
                held = piece
            if rows:
                yield emit(rows, edges)
        if held:
            yield emit([held], [True])

    return run


def sessionize(events: DataFrame, keys: list[str], time_ms: str, gap_ms: int, scratch: Scratch | None = None) -> DataFrame:
    """One row per session: the keys, ``start_ms``, ``end_ms``, ``n_events``.

    A gap of more than ``gap_ms`` starts a new session, an equal gap does not.
    Rows with a null time or a null key are left out.  Ties and repeated rows
    each count as an event.  Other columns are ignored, an empty table gives an
    empty result.  ``keys`` are read as strings.
    """
    spark = events.sparkSession
    scratch = scratch or Scratch(spark, "sessions")
    keyed = events.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(time_ms).cast("long").alias("ms"))
    keyed = keyed.where(F.col("ms").isNotNull())
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    keyed = scratch.save(keyed, "events")  # range partitioning reads its input twice, to sample and to move it
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, *keys, "ms").sortWithinPartitions(*keys, "ms")
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *[T.StructField(k, T.LongType()) for k in ("start_ms", "end_ms", "n")], T.StructField("edge", T.BooleanType())])
    parts = scratch.save(ordered.mapInArrow(_scan(keys, gap_ms), schema), "parts")
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    edges = parts.where("edge")
    opens = F.when(F.col("start_ms") - F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= gap_ms, 0).otherwise(1)
    joined = (
        edges.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "run")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"))
        .drop("run")
    )
    inner = parts.where(~F.col("edge")).drop("edge")
    return inner.unionByName(joined).withColumnRenamed("n", "n_events")


def request_sessions(attack_view: DataFrame, request_identity: DataFrame, gap_ms: int = 1_800_000) -> DataFrame:
    """Bursts of requests of each user and cache bucket.

    A request counts once, at its earliest readable instant; its user is the
    non-missing one among its identity rows (the smallest where two differ),
    trimmed and in lower case.  Requests without user, id or instant are left
    out; a null or blank bucket is ``cache_unavailable``.
    """
    requests = (
        attack_view.select("request_id", instant_millis(F.col("timestamp")).alias("ms"), F.when(F.trim("cache_bucket") != "", F.col("cache_bucket")).alias("cache_bucket"))
        .where(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(F.min("ms").alias("ms"), F.min("cache_bucket").alias("cache_bucket"))
        .where(F.col("ms").isNotNull())
    )
    users = request_identity.select("request_id", F.lower(present(F.col("user_id"))).alias("user_id")).where("request_id is not null and user_id is not null").groupBy("request_id").agg(F.min("user_id").alias("user_id"))
    events = requests.join(users, "request_id").select("user_id", bucket_or_unavailable(F.col("cache_bucket")).alias("cache_bucket"), "ms")
    found = sessionize(events, ["user_id", "cache_bucket"], "ms", gap_ms)
    return found.withColumnRenamed("n_events", "n_requests")
