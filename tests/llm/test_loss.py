import numpy as np

from tracemill.llm import packing, tokens


def test_turns_of_an_assistant_bear_loss():
    text = "user: one two\nassistant: three\n\nmore of it\ntool: x\nagent: vier"
    assert [text[a:b] for a, b in tokens.loss_spans(text)] == [" three\n\nmore of it\n", " vier"]
    assert tokens.loss_spans("no turns: here") is None
    wide = "user: é\nassistant: ü!"
    assert [wide.encode()[a:b].decode() for a, b in tokens.loss_spans(wide)] == [" ü!"]


def test_counts_of_pieces(spark):
    rows = [(1, "user: a b c\nassistant: d e f"), (2, " x" * 250), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as n_tokens", "8 as piece")
    got = {(r["doc_id"], r["piece"]): (r["first_token"], r["n_tokens"], r["loss_tokens"]) for r in tokens.count_pieces(df, 100).collect()}
    assert got[2, 0] == (0, 100, 99) and got[2, 2] == (200, 50, 49) and got[3, 0] == got[4, 0] == (0, 0, 0) and len(got) == 6
    whole = len(tokens.BytePairEncoder(tokens.read_ranks()).encode(rows[0][1]))
    assert got[1, 0][1] == whole and got[1, 0][2] == 3


def test_limits_bind_together_and_large_items_stay_whole():
    sizes = np.array([[60, 60, 1]] * 20 + [[60, 5, 1]] * 20 + [[99, 99, 1]] * 3 + [[1, 0, 1]] * 30)
    limits = np.array([120, 90, 6])
    bins = packing.pack_block(sizes, limits)
    for c in set(bins):
        t = sizes[bins == c]
        assert t[:, 0].sum() <= 120 and len(t) <= 6
        assert t[:, 1].sum() <= 90 or (t[:, 1] > 90).sum() == 1 and t[:, 1].sum() == t[:, 1].max()
    both = [c for c in set(bins) if {60, 5} <= set(sizes[bins == c][:, 1].tolist())]
    assert len(both) >= 18  # loss makes it pair long and short turns
