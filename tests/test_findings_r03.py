"""What round 3's findings asked for: work that grows no faster than the input."""

import numpy as np

from tests.test_encoding import tables
from tracefold.llm import lm
from tracefold.operators import grammar as G
from tracefold.operators import vocab as VO
from tracefold.streaming import jobs as J


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dedupe_batches_are_native_and_replayed(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "keys")
    cols = "input string, seq long, exit_code int"
    batches = [[("a", 2, 0), ("a", 1, 7), (None, None, 1), ("b", None, 2)], [("b", 0, 3), (None, 5, 4), ("c", 9, 5)], [("c", 1, 6)]]
    for k in (0, 1, 1, 2, 0):  # batches 1 and 0 are replayed
        J.dedupe_batch(spark.createDataFrame(batches[k], cols), out, state, k, "input", "seq")
    got = {(r.input, r.seq, r.exit_code) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1, 7), (None, None, 1), ("b", None, 2), ("c", 9, 5)}
    assert "Python" not in plan(J.first_rows(spark.createDataFrame(batches[0], cols), "input", "seq"))


def test_encoding_and_decoding_shuffle_no_row_a_token(spark):
    vocab = {"ab": 10, "b": 11, "abc": 12}
    df, v = tables(spark, vocab, [(1, "ab abcb b"), (2, None), (3, "x\u2003b"), (4, "b ab"), (4, "abb b b"), (None, "ab")])
    e = VO.encode_greedy(df, "text", v)
    want = [(1, [10, 12, 11, 11]), (2, []), (3, [1, 11]), (4, [10, 11, 11, 10, 11, 11]), (4, [10, 11, 11, 10, 11, 11]), (None, [])]
    assert sorted(((r.id, r.ids) for r in e.collect()), key=str) == sorted(want, key=str)
    assert "wpos" not in plan(e)
    d = VO.decode_ids(spark.createDataFrame([(1, [10, 0, 12, 99]), (2, None), (2, [11]), (None, [10])], "id long, ids array<long>"), "ids", v)
    assert sorted(((r.id, r.text) for r in d.collect()), key=str) == sorted([(1, "ab abc <unk>"), (2, "b"), (2, "b"), (None, "")], key=str)
    assert "Generate" not in plan(d)


def test_actions_and_vocabulary_are_ranked_from_stored_keys(spark):
    rows = [("[Input]", 0, "[x]"), ("[x]", 0, "x [xOptions]"), ("[xOptions]", 0, "-a"), ("[xOptions]", 1, " [b c] d "), ("[xOptions]", 2, ""), ("[xOptions]", 3, "-[n]-")]
    g = spark.createDataFrame(rows, G.GRAMMAR_SCHEMA)
    actions = G.production_actions(g, G.reachable_nonterminals(g))
    assert {r.production: r.action_id for r in actions.collect()} == {p: k for k, (_, _, p) in enumerate(rows)}
    assert "Aggregate" not in plan(actions) and "Join" not in plan(actions)
    v = VO.build_vocabulary(g)
    n = len(VO.SPECIALS) + len(VO.PRINTABLE)
    assert [r.token for r in v.where(f"id >= {n}").orderBy("id").collect()] == ["-a", "[b", "c]"]  # x, d and - are printable characters
    assert "regexp" not in plan(v)


def test_context_places_have_no_logits():
    model, r = lm.Attention(50), np.random.default_rng(1)
    x = r.integers(0, 50, (5, lm.WINDOW))
    whole = model._forward(x, lm.WINDOW)[-1].reshape(5, lm.WINDOW, -1)
    later = model._forward(x, lm.WINDOW, lm.OVERLAP)[-1].reshape(5, lm.WINDOW - lm.OVERLAP, -1)
    assert np.allclose(whole[:, lm.OVERLAP:], later, atol=1e-5)
