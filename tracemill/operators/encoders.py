"""Encoders of texts, and linkage by encoded texts.

An encoder is any function from an array column of terms to an array of
numbers, so a model can be put in as a pandas UDF.  The default needs no model:
terms are hashed to places, weighed, and the vector is brought to length one.
Vectors stay sparse (place to weight) where they are many.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..ship import ship
from .ordered import numbered

Encoder = Callable[[Column], Column]

# Words that carry no content.
STOP = "a an and are as at be by for from has have he her his i in is it its me my not of on or our she so that the their them they this to was we were will with you your".split()
WORD = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column, pairs: bool = True) -> Column:
    """Words of two or more letters in small letters, stop words left out, and pairs of neighbours."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda w: ~w.isin(*STOP))
    if not pairs:
        return words
    both = F.transform(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1_000_000_000).alias("b")), lambda z: z["b"].isNotNull()), lambda z: F.concat(z["a"], F.lit(" "), z["b"]))
    return F.concat(words, both)


def hashed_places(term_list: Column, size: int) -> Column:
    return F.transform(term_list, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))


def hashing_encoder(size: int = 256) -> Encoder:
    """Counts of hashed terms as a dense vector of length one."""

    def encode(term_list: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(lists: pd.Series) -> pd.Series:
            def one(places) -> np.ndarray:
                v = np.bincount(np.asarray(places, dtype=np.int64), minlength=size).astype(np.float32) if places is not None and len(places) else np.zeros(size, np.float32)
                n = float(np.linalg.norm(v))
                return v / n if n else v

            return lists.map(one)

        return run(hashed_places(term_list, size))

    return encode


def encode_documents(documents: DataFrame, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """Adds ``vector``; equal texts are encoded once and joined back by their hash."""
    keyed = documents.withColumns({"_a": F.xxhash64(text_col), "_b": F.xxhash64(F.lit(7), F.col(text_col))})
    once = keyed.groupBy("_a", "_b").agg(F.first(text_col).alias("_text")).select("_a", "_b", encoder(terms(F.col("_text"))).alias("vector"))
    return keyed.join(once, ["_a", "_b"]).drop("_a", "_b")


# -- nearest earlier text within a window ---------------------------------------------
#: Requests that are compared with one another at once; also how many earlier ones a request is compared with at most.
ACTIVE = 2_048


def _sparse(lists: list, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for places in lists:
        at, n = np.unique(np.asarray(places if places is not None else [], dtype=np.int64), return_counts=True)
        w = n.astype(np.float32)
        norm = float(np.linalg.norm(w))
        out.append((at, w / norm if norm else w))
    return out


def _products(now: list[tuple[np.ndarray, np.ndarray]], before: list[tuple[np.ndarray, np.ndarray]], size: int, step: int = 2_048) -> np.ndarray:
    """Cosines of two lists of sparse vectors, by dense products over slices of the places."""
    total = np.zeros((len(now), len(before)), np.float32)
    for lo in range(0, size, step):
        sides = []
        for side in (now, before):
            m = np.zeros((len(side), step), np.float32)
            for i, (at, w) in enumerate(side):
                a, b = np.searchsorted(at, (lo, lo + step))
                m[i, at[a:b] - lo] = w[a:b]
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total


def nearest_earlier(rows: DataFrame, window_seconds: int = 5_400, least: float = 0.72, margin: float = 0.04, size: int = 1 << 15, active: int = ACTIVE) -> DataFrame:
    """The most alike earlier text of each request: ``request_id``, ``predecessor_id``, ``score``, ``runner_up_score``, ``disposition``.

    ``rows``: ``request_id``, ``second``, ``text``.  Compared are the ``active``
    requests before it in time, within the window; it is accepted with a cosine
    of ``least`` that leads by ``margin``.  Requests are numbered by time over
    the whole log and cut into blocks of ``active``: what a request is compared
    with is in its own block or the one before, so a task holds two blocks and
    the work is linear in the requests.  Rows without an instant abstain.
    """
    ship(rows.sparkSession)
    timed = rows.where("second is not null").select("request_id", "second", hashed_places(terms(F.col("text")), size).alias("places"))
    placed = Scratch(rows.sparkSession, "nearest").save(numbered(timed, ["second", "request_id"]).withColumn("n", F.col("n") - 1), "placed")
    own = F.floor(F.col("n") / active).cast("long")
    twice = placed.select("*", F.explode(F.array(own, own + 1)).alias("block"), own.alias("home"))

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("n", ignore_index=True)
        here = block[block["home"] == key[0]]
        if not len(here):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("request_id", "predecessor_id", "score", "runner_up_score")})
        vectors = _sparse(list(block["places"]), size)
        s = _products([vectors[i] for i in here.index], vectors, size).astype(np.float64)
        n, sec = block["n"].to_numpy(), block["second"].to_numpy()
        gap, age = n[here.index][:, None] - n[None, :], sec[here.index][:, None] - sec[None, :]
        s[(gap <= 0) | (gap > active) | (age > window_seconds)] = -1.0
        s = np.round(s, 6)
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best]
        # of equal scores the greatest id leads
        ids = np.array(block["request_id"].tolist(), dtype=object)
        for i in np.flatnonzero((s == top[:, None]).sum(axis=1) > 1):
            if top[i] >= 0:
                ties = np.flatnonzero(s[i] == top[i])
                best[i] = ties[np.argmax(ids[ties].astype(str))]
        rest = s.copy()
        rest[np.arange(len(s)), best] = -1.0
        second = np.maximum(0.0, rest.max(axis=1))
        found = top >= 0
        plain = lambda xs: pd.Series(list(xs), dtype=object)  # noqa: E731  (a string type of its own isn't taken back)
        return pd.DataFrame({"request_id": plain(here["request_id"]), "predecessor_id": plain(ids[b] if f else None for b, f in zip(best, found, strict=True)), "score": np.maximum(0.0, top), "runner_up_score": second})

    got = twice.groupBy("block").applyInPandas(run, "request_id string, predecessor_id string, score double, runner_up_score double")
    out = rows.select("request_id").join(got, "request_id", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "runner_up_score": F.coalesce("runner_up_score", F.lit(0.0))})
    good = F.col("predecessor_id").isNotNull() & (F.col("score") >= least) & (F.col("score") - F.col("runner_up_score") >= margin)
    return out.withColumn("disposition", F.when(good, "accept").otherwise("abstain"))


# -- an index of cells ------------------------------------------------------------------
#: Rows on which the cells are fitted and the probes are chosen, and queries among them.
FIT_ROWS, FIT_QUERIES = 20_000, 64


def _fit(x: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for i in range(cells):
            members = x[own == i]
            if len(members):
                m = members.mean(axis=0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, want: float) -> int:
    """The fewest cells a query must look into for the wanted recall, measured on the sample."""
    q = x[:FIT_QUERIES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argsort(-s, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)  # of each query, the place of each cell
    own = (x @ c.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(want * len(needed))) - 1)]) + 1


def cell_index(vectors: DataFrame, k: int = 10, want: float = 0.92, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray, int]:
    """Every row with its cell (``id``, ``v``, ``cell``), the cells' centres, and how many cells a query looks into.

    Cells are as many as the root of the number of rows (at most 4,096, so the
    centres, which go to the workers, are bounded), fitted on at most
    ``FIT_ROWS`` rows of smallest hash; the number of probes is the least that
    reaches the wanted recall on ``FIT_QUERIES`` of them.  Every row is indexed.
    """
    from .similarity import unit

    ship(vectors.sparkSession)
    kept = Scratch(vectors.sparkSession, "cells").save(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), unit(F.col(vec_col)).alias("v")), "vectors")
    n = kept.count()
    sample = np.array([r["v"] for r in kept.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_ROWS).select("v").collect()], dtype=np.float64)
    if not len(sample):
        return kept.withColumn("cell", F.lit(0)), np.zeros((1, 1)), 1
    centres = _fit(sample, max(1, min(4_096, int(n**0.5), len(sample))), seed)
    return kept.select("id", "v", nearest_cells(F.col("v"), centres, 1)[0].alias("cell")), centres, _probes(sample, centres, k, want)


def nearest_cells(v: Column, centres: np.ndarray, probes: int) -> Column:
    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        s = np.stack(rows.to_numpy()) @ centres.T
        return pd.Series(list(np.argsort(-s, axis=1)[:, :probes].astype(np.int32)))

    return run(v)


def cell_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, want: float = 0.92, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Approximate top-k of each query by the cells it looks into (``query_id``, ``id``, ``score``, ``rank``), and the number of candidates of each query."""
    from .similarity import unit

    scratch = Scratch(vectors.sparkSession, "cells")
    rows, centres, probes = cell_index(vectors, k, want, seed, id_col, vec_col)
    rows = scratch.save(rows, "rows")
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), unit(F.col(vec_col)).alias("qv"))
    looked = asked.select("query_id", "qv", F.explode(nearest_cells(F.col("qv"), centres, probes)).alias("cell"))
    met = looked.join(rows, "cell").where("query_id <> id")
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = scratch.save(met.select("query_id", "id", dot.alias("score")), "scored")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top, scored.groupBy("query_id").agg(F.count("*").alias("candidates"))


def index_report(vectors: DataFrame, queries: DataFrame, exact: DataFrame, k: int = 10, want: float = 0.92, **names: str) -> DataFrame:
    """One row: recall of the index against the exact neighbours, and the share of all rows that a query is compared with."""
    found, candidates = cell_neighbours(vectors, queries, k, want, **names)
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.count("*").alias("neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    n = vectors.agg(F.count("*").alias("rows"))
    c = candidates.agg(F.coalesce(F.avg("candidates"), F.lit(0.0)).alias("candidates"))
    return hit.crossJoin(c).crossJoin(n).select("neighbours", "found", (F.col("found") / F.greatest(F.lit(1), F.col("neighbours"))).alias("recall"), (F.col("candidates") / F.greatest(F.lit(1), F.col("rows"))).alias("compared_share"))


# -- dense and sparse scores together ---------------------------------------------------
def tfidf(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id``, ``term``, ``weight``: (1 + ln count) * (1 + ln((1 + N) / (1 + df))), vectors of length one."""
    counts = documents.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col), pairs=False)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    counts = Scratch(documents.sparkSession, "tfidf").save(counts, "counts")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = documents.agg(F.count("*").alias("total"))
    raw = counts.join(df, "term").crossJoin(total).select("id", "term", ((1 + F.log("n")) * (1 + F.log((1 + F.col("total")) / (1 + F.col("df"))))).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def combined_scores(pairs: DataFrame, dense: DataFrame, sparse: DataFrame, alpha: float, floor: float) -> DataFrame:
    """``left``, ``right``, ``score``: alpha * dense + (1 - alpha) * sparse cosine of candidate pairs whose sparse cosine is at least the floor.

    ``pairs``: ``left``, ``right``; ``dense``: ``id``, ``vector``; ``sparse``: as ``tfidf`` gives it.
    """
    side = lambda tag: sparse.select(F.col("id").alias(tag), "term", F.col("weight").alias(f"{tag}_w"))
    s = pairs.join(side("left"), "left").join(side("right"), ["right", "term"]).groupBy("left", "right").agg(F.sum(F.col("left_w") * F.col("right_w")).alias("sparse")).where(F.col("sparse") >= floor)
    vec = lambda tag: dense.select(F.col("id").alias(tag), F.col("vector").alias(f"{tag}_v"))
    dot = F.aggregate(F.zip_with("left_v", "right_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return s.join(vec("left"), "left").join(vec("right"), "right").select("left", "right", "sparse", dot.alias("dense"), (alpha * dot + (1 - alpha) * F.col("sparse")).alias("score"))


# -- profiles by meaning ------------------------------------------------------------------
def semantic_profiles(spans: DataFrame, ontology: dict[str, dict[str, str]], labels: DataFrame, encoder: Encoder | None = None, floor: float = 0.25, per_field: int = 2, threshold: float = 0.25, support: int = 2, margin: float = 0.10) -> DataFrame:
    """``label``, ``field``, ``value``, ``score``, ``n_requests``: values whose descriptions are near to spans of a cluster.

    ``spans``: ``request_id``, ``span``; ``ontology``: field to value to
    description, a fixed small list that meets every distinct span.  A span
    votes for its best ``per_field`` values of a field from ``floor`` on, unless
    it negates them; a cluster keeps a value with ``support`` requests, a best
    score of ``threshold``, and no more than ``margin`` below the field's best.
    """
    from .documents import contradicted

    encoder = encoder or hashing_encoder()
    rows = [(f, v, d) for f, values in ontology.items() for v, d in values.items()]
    known = spans.sparkSession.createDataFrame(rows, "field string, value string, text string").select("field", "value", encoder(terms(F.col("text"))).alias("o"))
    scratch = Scratch(spans.sparkSession, "semantic")
    once = scratch.save(encode_documents(spans.select(F.col("span").alias("text")).distinct(), encoder), "spans")
    dot = F.aggregate(F.zip_with("vector", "o", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    met = once.crossJoin(F.broadcast(known)).select("text", "field", "value", dot.alias("score")).where((F.col("score") >= floor) & ~contradicted(F.col("text"), F.col("value")))  # the ontology is a stated list
    w = Window.partitionBy("text", "field").orderBy(F.desc(F.round("score", 9)), "value")
    votes = scratch.save(met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_field).drop("r"), "votes")
    each = spans.select("request_id", F.col("span").alias("text")).join(votes, "text").join(labels, "request_id")
    held = each.groupBy("label", "field", "value").agg(F.max("score").alias("score"), F.count_distinct("request_id").alias("n_requests"))
    best = F.max("score").over(Window.partitionBy("label", "field"))
    return held.withColumn("best", best).where((F.col("score") >= threshold) & (F.col("n_requests") >= support) & (F.col("best") - F.col("score") <= margin)).drop("best")
