"""Groups of requests that are alike, over all pairs that share a value, without a row a pair.

Values that the same requests hold count as one, with a weight.  Requests are
cut into blocks, and every two blocks are compared in one task: for a request,
the weights of its values are added up over the lists of the other block's
holders, so each pair that shares anything is scored exactly.  Only links that
join two groups leave the task, at most one a request, level and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Families by number: the two lowest bits of a value.
FAMILIES = ("shingles", "ids", "repo", "domain")
#: Requests a block; small tables get at least four blocks, so that all cores have work.
BLOCK = 32_768
#: Holders in a block from which on a value counts as one of many, at least (a sixteenth of the block otherwise).
HOT = 8
#: Bits of a count of identifiers, repositories or domains where the three are added up as one number.
_BITS = 17

_PACKED = "b int, ids array<string>, sizes binary, counts binary, at binary, values binary, weights binary"


def coded(**families: Column) -> Column:
    """Arrays of the families as one array of values (hashes)."""

    def marked(values: Column, k: int) -> Column:
        return F.transform(values, lambda v: F.xxhash64(v).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(k).cast("long")))

    return F.concat(*[marked(families[name], k) for k, name in enumerate(FAMILIES)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _postings(parts: int, negative: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The values of a batch of requests, those below zero or the others, by part: keys, and places among the keys and values as arrays of numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch["key"].to_numpy(), batch["values"]
            values = lists.flatten().to_numpy()
            at = np.repeat(np.arange(len(keys), dtype=np.int32), pc.list_value_length(lists).to_numpy())
            mine = (values < 0) == negative
            values, at = values[mine], at[mine]
            part = ((values >> 2) % parts).astype(np.int32)
            order = np.argsort(part, kind="stable")
            values, at, bounds = values[order], at[order], np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
            rows = [(p, i, j) for p, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if j > i]
            blobs = lambda x: pa.array([x[i:j].tobytes() for _, i, j in rows], pa.binary())
            yield pa.record_batch({"part": pa.array([p for p, _, _ in rows], pa.int32()), "keys": pa.array([keys.tobytes()] * len(rows), pa.binary()), "at": blobs(at), "values": blobs(values)})

    return cut


def _part_sets(table: pa.Table) -> pa.Table:
    """The sets of holders of a part's values: family, number and two hashes, smallest value, and number of values."""
    keys, values = [], []
    for row in table.to_pylist():
        keys.append(np.frombuffer(row["keys"], np.uint64)[np.frombuffer(row["at"], np.int32)])
        values.append(np.frombuffer(row["values"], np.int64))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(values, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    n = np.diff(np.append(first, len(values)))
    x, y = np.bitwise_xor.reduceat(_mixed(keys), first), np.add.reduceat(_mixed(keys ^ np.uint64(0x9E3779B97F4A7C15)), first)
    many = n > 1
    value, n, x, y = values[first][many], n[many], x[many].view(np.int64), y[many].view(np.int64)
    order = np.lexsort((value, n, y, x, value & 3))
    value, n, x, y = value[order], n[order], x[order], y[order]
    new = np.concatenate(([True], ((value[1:] ^ value[:-1]) & 3 != 0) | (n[1:] != n[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(value)]
    first = np.flatnonzero(new)
    return pa.table({"family": (value & 3)[first], "n": n[first].astype(np.int64), "x": x[first], "y": y[first], "value": value[first], "weight": np.diff(np.append(first, len(value))).astype(np.int64)})


#: Values that one task groups at a time.
PART = 2_000_000


def held_sets(f: DataFrame, scratch: Scratch) -> DataFrame:
    """``key``, ``value``, ``weight``: of every set of values that the same requests hold, its smallest value, and how many they are.

    ``f``: ``key``, ``values`` (distinct).  Sets are told apart by family,
    number and two 64-bit hashes of the holders; values of one request are left
    out.  The values below zero and the others go one after the other, so that
    only half of them is in shuffle files at a time.
    """
    total = f.agg(F.sum(F.size("values"))).first()[0] or 0
    parts = max(8, -(-total // (2 * PART)))
    local = []
    for negative in (True, False):
        cut = f.select("key", "values").mapInArrow(_postings(parts, negative), "part int, keys binary, at binary, values binary")
        local.append(scratch.save(cut.groupBy("part").applyInArrow(_part_sets, "family long, n long, x long, y long, value long, weight long"), f"local{negative}"))
    sets = local[0].unionByName(local[1]).groupBy("family", "n", "x", "y").agg(F.min("value").alias("value"), F.sum("weight").alias("weight"))
    sets = scratch.save(sets.select("value", "weight"), "sets")
    scratch.drop("localTrue", "localFalse")
    out = []
    for negative in (True, False):
        half = (F.col("value") < 0) == F.lit(negative)
        out.append(scratch.save(f.select("key", F.explode("values").alias("value")).where(half).join(sets.where(half), "value"), f"held{negative}"))
    return out[0].unionByName(out[1])


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """A block of requests as one row: the values that occur with their weights, and each request's places among them."""
    counts = pc.list_value_length(table["held"]).to_numpy().astype(np.int64)
    held = table["held"].combine_chunks().flatten()
    values, first, at = np.unique(held.field("value").to_numpy(), return_index=True, return_inverse=True)
    weights = held.field("weight").to_numpy()[first]
    blobs = (table["size"].to_numpy().astype(np.int64), counts, at.astype(np.int32), values, weights.astype(np.int64))
    names = ("sizes", "counts", "at", "values", "weights")
    return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([table["request_id"].to_pylist()], pa.list_(pa.string())), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, blobs, strict=True)}})


class Block:
    """A packed block: sizes, bounds and places of its requests, and its values."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(row["counts"], np.int64))))
        self.at, self.values, self.weights = np.frombuffer(row["at"], np.int32), np.frombuffer(row["values"], np.int64), np.frombuffer(row["weights"], np.int64)

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each value's requests, and these requests."""
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), np.diff(self.bounds))
        return np.concatenate(([0], np.cumsum(np.bincount(self.at, minlength=len(self.values))))), owner[np.argsort(self.at, kind="stable")]


def scores(a: Block, b: Block, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each request of ``a``: those of ``b`` with a similarity of at least ``least``, the similarity, and how many identifiers, repositories and domains they share."""
    bounds, holders = b.holders()
    place = np.searchsorted(b.values, a.values)
    place[place == len(b.values)] = 0
    common = b.values[place] == a.values if len(b.values) else np.zeros(len(a.values), bool)
    family = a.values & 3
    weight = np.where(family == 0, a.weights, a.weights << np.maximum(0, (family - 1) * _BITS)).astype(np.float64)
    # shared / (x + y - shared) >= least means shared >= least / (1 + least) * (x + y); a little less, the exact test follows
    share = least / (1 + least) * (1 - 1e-9)
    wanted = b.sizes * share
    n = len(b.sizes)
    hot = common & (np.diff(np.append(bounds, bounds[-1]))[place] >= max(HOT, n // 16)) if len(b.values) else common

    def added(at: np.ndarray) -> np.ndarray:
        from_, to = bounds[place[at]], bounds[place[at] + 1]
        lists = [holders[i:j] for i, j in zip(from_.tolist(), to.tolist(), strict=True)]
        return np.bincount(np.concatenate(lists), np.repeat(weight[at], to - from_), n) if lists else np.zeros(n)

    def parted(mine: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
        """Each request's values of few holders, and its values of many (as bytes, for requests share these)."""
        owner = np.repeat(np.arange(len(a.sizes)), np.diff(a.bounds))
        keep = common[a.at] & mine[a.at]
        owner, at = owner[keep], a.at[keep]
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        many = hot[at]
        cut = lambda of: np.split(at[of], np.cumsum(np.bincount(owner[of], minlength=len(a.sizes)))[:-1])
        return cut(~many), [x.tobytes() for x in cut(many)]

    few, many = parted(family == 0)
    other_few, other_many = parted(family > 0)
    base, of_base, other_base, of_other = np.zeros(0), None, np.zeros(0), None
    low = (1 << _BITS) - 1
    # requests with the same values of many holders follow one another, so these are added up once for them
    for x in sorted(range(len(a.sizes)), key=lambda i: (many[i], other_many[i])):
        if not (len(few[x]) or many[x]):
            continue
        if many[x] != of_base:
            base, of_base = added(np.frombuffer(many[x], np.int32)) - wanted, many[x]
        over = base + added(few[x]) if len(few[x]) else base
        near = np.flatnonzero(over >= share * a.sizes[x])
        shared = np.rint(over[near] + wanted[near])
        alike = shared / (a.sizes[x] + b.sizes[near] - shared)
        near, alike = near[alike >= least], alike[alike >= least]
        if not len(near):
            continue
        if other_many[x] != of_other:
            other_base, of_other = added(np.frombuffer(other_many[x], np.int32)).astype(np.int64), other_many[x]
        other = other_base[near]
        if len(other_few[x]):
            other = other + added(other_few[x])[near].astype(np.int64)
        yield x, near, alike, other & low, (other >> _BITS) & low, other >> 2 * _BITS


class Groups:
    """Groups of numbers, joined by a number and an array of others at a time; a group's label is its smallest number.

    A join only notes where labels lead to; all labels are brought up to date every ``LAZY`` joins.
    """

    LAZY = 32

    def __init__(self, n: int):
        self.label, self.to, self.late = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), 0

    def _ends(self, labels: np.ndarray) -> np.ndarray:
        while True:
            further = self.to[labels]
            if (further == labels).all():
                return labels
            labels = further

    def join(self, x: int, others: np.ndarray) -> None:
        labels, mine = self.label[others], self.label[x]
        labels = labels[labels != mine]
        if not len(labels):
            return
        labels = self._ends(np.append(np.unique(labels), mine))
        if (labels != labels[0]).any():
            self.to[labels] = labels.min()
            self.late += 1
            if self.late == self.LAZY:
                self.labels()

    def labels(self) -> np.ndarray:
        self.label, self.late = self._ends(self.label), 0
        self.to = np.arange(len(self.label), dtype=np.int32)
        return self.label


def links(requests: DataFrame, held: DataFrame, rules: dict[str, Callable], least: float, scratch: Scratch, block: int | None = None) -> DataFrame:
    """``level``, ``u``, ``v``: links that give the groups of each level of ``rules``.

    ``requests``: ``request_id``, ``key``, ``size`` (its shingles).  A rule has
    the similarity and the shared identifiers, repositories and domains of
    pairs, and says which of them link; pairs below ``least`` never do.
    """
    n = requests.count()
    blocks = max(1, -(-n // (block or max(1, min(BLOCK, -(-n // 4))))))
    rows = requests.join(held.groupBy("key").agg(F.collect_list(F.struct("value", "weight")).alias("held")), "key")
    rows = rows.select(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(blocks)).cast("int").alias("b"), "request_id", "size", "held")
    packed = scratch.save(rows.repartition(blocks, "b").groupBy("b").applyInArrow(_pack, _PACKED), "blocks")

    def compare(table: pa.Table) -> pa.Table:
        sides = [Block(row) for row in sorted(table.to_pylist(), key=lambda row: row["b"])]
        a, b = sides[0], sides[-1]
        ids = a.ids + b.ids if a is not b else a.ids
        shift = len(a.ids) if a is not b else 0
        groups = {level: Groups(len(ids)) for level in rules}
        for x, near, *scored in scores(a, b, least):
            for level, rule in rules.items():
                which = near[rule(*scored)]
                if len(which):
                    groups[level].join(x, which + shift)
        ids = pa.array(ids, pa.string())
        out = []
        for level, g in groups.items():
            label = g.labels()
            moved = np.flatnonzero(label != np.arange(len(label)))
            out.append(pa.table({"level": pa.array([level] * len(moved), pa.string()), "u": ids.take(pa.array(label[moved])), "v": ids.take(pa.array(moved))}))
        return pa.concat_tables(out)

    every = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("task", F.least("b", "k") * blocks + F.greatest("b", "k"))
    # blocks that nothing hashed to leave tasks with one side, which is then compared with itself once more
    return scratch.save(every.repartition(blocks * (blocks + 1), "task").groupBy("task").applyInArrow(compare, "level string, u string, v string"), "links")
