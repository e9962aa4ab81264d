"""Scans of message contents that look at each text about once.

Requests repeat the messages of earlier ones, so a batch of requests holds the
same text many times.  The scan sends the nested column to Python as it is
(no explode, no shuffle of texts), numbers the batch's distinct texts in
native code, looks at each of them once, remembers results over batches within
a bound, and repeats them for every place of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Characters of remembered texts in a worker before all are forgotten.
REMEMBERED = 24_000_000
#: Bytes of text that are looked at as one batch.
BATCH_BYTES = 16_000_000


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lists = batch.column("contents")
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    flat = lists.flatten()
    np.add.at(sizes, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    cut = np.cumsum(sizes) // BATCH_BYTES
    starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist()]
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def scan_contents(attack_view: DataFrame, make: Callable[[], Callable[[str], list[tuple]]], fields: list[tuple[str, str]]) -> DataFrame:
    """``request_id``, ``message_index`` and the found rows' fields, of every message.

    ``make()`` is called once a worker and gives a function from a text to its
    rows.  ``fields``: name and SQL type (``string``, ``int``) of the rows'
    parts.  Null ids, null or empty messages and contents give nothing.  Rows
    are not distinct: a further delivery repeats them.
    """
    ship(attack_view.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = make()
        remembered: dict[str, list[tuple]] = {}
        held = 0
        for whole in batches:
            for batch in _parts(whole):
                lists = batch.column("contents")
                parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                index = np.arange(len(parent)) - np.searchsorted(parent, parent, side="left")
                coded = lists.flatten().dictionary_encode()
                found: list[list[tuple]] = []
                for text in coded.dictionary.to_pylist():
                    if not text:
                        found.append([])
                        continue
                    rows = remembered.get(text)
                    if rows is None:
                        rows = look(text)
                        if held > REMEMBERED:
                            remembered.clear()
                            held = 0
                        remembered[text] = rows
                        held += len(text)
                    found.append(rows)
                if not any(found):
                    continue
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
                hit = np.array([bool(r) for r in found])
                places = np.flatnonzero((codes >= 0) & hit[codes])
                each = [found[c] for c in codes[places].tolist()]
                times = np.array([len(e) for e in each])
                at = np.repeat(places, times)
                flat = [row for e in each for row in e]
                columns = [batch.column("request_id").take(pa.array(parent[at])), pa.array(index[at], pa.int64())]
                columns += [pa.array([r[i] for r in flat], kinds[t]) for i, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(columns, names=["request_id", "message_index", *[n for n, _ in fields]])

    read = attack_view.where(F.col("request_id").isNotNull()).select(F.col("request_id").cast("string"), F.transform("messages", lambda m: m["content"]).alias("contents"))
    schema = ", ".join(["request_id string", "message_index bigint", *[f"{n} {t}" for n, t in fields]])
    return read.mapInArrow(run, schema)
