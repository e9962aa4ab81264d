"""Filling fixed-capacity containers with items.

Method: vector bin packing with the dot-product heuristic.  An item is a text
or a piece of one, with three sizes: tokens, segments and loss-bearing tokens.
A container has a limit on each.  The open container takes, of the items that
fit all three limits, the one whose sizes have the greatest dot product with
what is left of the limits (all in shares of the limits); when nothing fits,
it is closed.  Items of equal sizes are one class, so a step looks at classes,
of which there are few, and not at items.

Tokens have a hard limit, the capacity.  The limits on segments and on
loss-bearing tokens (in transcripts those of the assistant's turns) bind when
items are put together: an item that is over one of them by itself stays
whole, and its container takes nothing more of that kind.

A text larger than the capacity is cut into full pieces and a remainder; the
full pieces fill containers of their own, the remainder is an item like others.

Items are spread over blocks by hash, each of about ``BLOCK_ITEMS`` items, and
a block is packed by one task; the only loss against packing all items at once
is one partly filled container a block.  Nothing but the count of items comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .tokens import DEFAULT_TOKENIZER, TOKENIZER_DIR, count_pieces

#: Items a task packs at once.
BLOCK_ITEMS = 20_000
#: Pieces of a container at most, and the share of its tokens that may bear loss where items are put together.
MOST_SEGMENTS, LOSS_SHARE = 24, 0.99


def pack_block(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container (0, 1, ...) of each row of ``sizes`` (items x dimensions).

    The first dimension's limit holds for every item; of the others an item may
    be over the limit and opens a container then, which has no room left in
    that dimension.  Rows of zeros need no room and go to container 0.
    """
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    classes, member = np.unique(sizes, axis=0, return_inverse=True)
    member = member.ravel()
    order = np.argsort(member, kind="stable")
    first = np.searchsorted(member[order], np.arange(len(classes) + 1))
    left = np.diff(first)
    given = first[:-1].copy()
    shares = classes / limits
    empty = ~classes.any(axis=1)
    for c in np.flatnonzero(empty):
        left[c] = 0
    container = 0
    room = limits.astype(np.int64).copy()
    live = np.flatnonzero(left > 0)
    opened = False
    while len(live):
        fits = (classes[live] <= room).all(axis=1)
        if not opened:  # what is over a soft limit by itself can only open a container
            large = (classes[live] > limits).any(axis=1)
            if large.any():
                fits = large
        if not fits.any():
            container += 1
            room = limits.astype(np.int64).copy()
            opened = False
            continue
        options = live[fits]
        best = options[np.argmax(shares[options] @ (room / limits))]
        step = classes[best]
        use = step > 0
        times = 1 if opened or (step > room).any() else max(1, min(int(left[best]), int((room[use] // step[use]).min()) - 1))
        at = given[best]
        out[order[at : at + times]] = container
        given[best] += times
        left[best] -= times
        room = np.maximum(0, room - step * times)
        opened = True
        if not left[best]:
            live = live[live != best]
    for c in np.flatnonzero(empty):
        out[order[first[c] : first[c + 1]]] = 0
    return out


def pack(items: DataFrame, keys: list[str], dims: list[str], limits: list[int], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``items`` (its keys and sizes) with ``container_id``.

    Sizes are non-negative and at most the limits; null sizes count as 0.  An
    empty table gives an empty result; repeated rows are items of their own.
    """
    scratch = Scratch(items.sparkSession, "packing")
    kept = scratch.save(items.select(*keys, *[F.coalesce(F.col(d).cast("long"), F.lit(0)).alias(d) for d in dims]), "items")
    blocks = max(1, -(-kept.count() // block_items))
    schema = ", ".join([*[f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys], *[f"`{d}` bigint" for d in dims], "container_id bigint"])
    bounds = np.asarray(limits, dtype=np.int64)

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(keys, ignore_index=True)
        block["container_id"] = int(key[0]) * (1 << 32) + pack_block(block[dims].to_numpy(np.int64), bounds)
        return block[[*keys, *dims, "container_id"]]

    # a stated number of partitions, so that small blocks are not put together into one task
    apart = kept.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).repartition(blocks, "block")
    return apart.groupBy("block").applyInPandas(run, schema)


def pack_documents(documents: DataFrame, capacity: int = 2048, most_segments: int = MOST_SEGMENTS, loss_share: float = LOSS_SHARE, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The documents' pieces with their containers.

    Columns: the id, ``piece`` (0, 1, ...), ``first_token`` (where the piece
    starts in its document), ``n_tokens``, ``loss_tokens`` and ``container_id``.
    Limits: ``capacity`` tokens, ``loss_share`` of it in loss-bearing tokens,
    ``most_segments`` pieces.  A document is whole unless it is larger than
    ``capacity``.  Null and empty texts are one piece without tokens, which
    takes no room and no segment.
    """
    items = count_pieces(documents, capacity, id_col, text_col, tokenizer, folder).withColumn("segments", (F.col("n_tokens") > 0).cast("int"))
    return pack(items, [id_col, "piece", "first_token"], ["n_tokens", "loss_tokens", "segments"], [capacity, int(capacity * loss_share), most_segments]).drop("segments")


def fill_summary(packed: DataFrame, capacity: int, most_segments: int = MOST_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """One row: containers, tokens, how full the containers are in each dimension, and in how many each limit is reached.

    A limit on segments or loss is reached where nothing of that kind has room.
    """
    most = int(capacity * loss_share)
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.sum("loss_tokens").alias("loss"), F.count_if(F.col("n_tokens") > 0).alias("segments"))
    whole = F.count("*")
    share = lambda c, limit: F.coalesce(F.sum(c) / (whole * limit), F.lit(0.0))
    return each.agg(
        whole.alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"), share("n", capacity).alias("filled"), share("loss", most).alias("loss_filled"), share("segments", most_segments).alias("segments_filled"),
        F.count_if(F.col("loss") >= most).alias("at_loss_limit"), F.count_if(F.col("segments") >= most_segments).alias("at_segment_limit"),
    )
