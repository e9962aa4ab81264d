import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return tokens.BytePairEncoder(tokens.read_ranks())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens.read_ranks())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_merges(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_hard_pieces(encoder, reference):
    rng = random.Random(1)
    for text in ["a" * 4000, " " * 3000 + "x", "aab" * 900, "\x1c\x1d a\x85b", "½²٣", "don't WE'LL", "<|endoftext|>", "\r\n\r\n  \n x", *("".join(rng.choice("thearnsio") for _ in range(40)) for _ in range(300))]:
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_corpus(spark, encoder):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, " \n"), (4, " \n"), (None, "x"), (5, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as id", "array(1) as ids")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted(((i, encoder.encode(t)) for i, t in rows), key=str)
    assert all(r["same"] for r in tokens.round_trip(df).collect())
    assert tokens.encode_corpus(df.where("false")).count() == 0


def test_packing_keeps_limits_and_everything(spark):
    rng = random.Random(2)
    docs = [(i, " a" * rng.choice([0, 1, 3, 10, 40, 90, 130, 250])) for i in range(300)] + [(1000, None), (1001, " b" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as container_id")
    packed = packing.pack_documents(df, capacity=100, most_segments=5).collect()
    total, count, loss, whole = {}, {}, {}, {}
    for r in packed:
        c = r["container_id"]
        total[c] = total.get(c, 0) + r["n_tokens"]
        loss[c] = loss.get(c, 0) + r["loss_tokens"]
        count[c] = count.get(c, 0) + (r["n_tokens"] > 0)
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(total.values()) <= 100 and max(count.values()) <= 5 and max(loss.values()) <= 100
    sizes = {i: len((t or "").split()) for i, t in docs}
    assert {d: sum(n for _, _, n in p) for d, p in whole.items()} == sizes
    assert all(len(p) == max(1, -(-sizes[d] // 100)) and sorted(p)[0][1] == 0 for d, p in whole.items())
    assert packing.pack_documents(df.where("false"), 100).count() == 0


def test_block_fill():
    rng = np.random.default_rng(3)
    sizes = np.stack([s := rng.integers(1, 400, 5000), np.maximum(0, s - 1), np.ones(5000, int)], axis=1)
    bins = packing.pack_block(sizes, np.array([2048, 2048, 64]))
    used = np.bincount(bins, weights=sizes[:, 0])
    assert used.max() <= 2048 and sizes[:, 0].sum() / (len(used) * 2048) > 0.99
