"""Memo keys of whole command sequences, registry and streams with nulls."""

import random

import pandas as pd

from pyspark.sql import functions as F

from tracefold.operators import redundancy as R
from tracefold.operators.curation import exclude_known_inputs
from tracefold.sources.traces_io import load_registry, save_registry
from tracefold.streaming import jobs as J


def sequences(spark, rows):
    df = spark.createDataFrame(rows, "seq long, cmds array<string>")
    earlier, args = R.sequence_parts(F.col("cmds"))
    return df.select("seq", earlier.alias("earlier"), args.alias("args"))


def test_variant_keys_are_the_keys_of_the_variants(spark):
    r = random.Random(4)
    rows = [(i, [r.choice(["cd /a", "cd /b"]), " ".join(["util"] + [r.choice("ab") for _ in range(r.randint(0, 9))])]) for i in range(150)]
    rows += [(900, []), (901, None), (902, ["one"]), (903, ["x y z"])]
    s = sequences(spark, rows)
    got = {(x.seq, x.dropped_pos): x.key for x in R.variant_keys(s, "seq", "earlier", "args").collect()}
    whole = {x.seq: x.key for x in s.select("seq", R.sequence_key("earlier", "args").alias("key")).collect()}
    assert whole[900] is None and whole[901] is None and whole[902] is not None
    tokens = {i: (tuple(c[:-1]), tuple(c[-1].split(" "))) for i, c in rows if c}
    assert got.keys() == {(i, p) for i, (_, t) in tokens.items() for p in range(1, len(t))}
    by_key: dict = {}
    for (i, p), k in got.items():
        e, t = tokens[i]
        by_key.setdefault(k, set()).add((e, t[:p] + t[p + 1:]))
    for i, k in whole.items():
        if k is not None:
            by_key.setdefault(k, set()).add(tokens[i])
    assert all(len(v) == 1 for v in by_key.values())          # one key, one sequence
    assert len(by_key) == len(set.union(*by_key.values()))    # one sequence, one key


def test_pending_and_memo_see_the_earlier_commands(spark):
    s = sequences(spark, [(1, ["cd /a", "ls -l -a"]), (2, ["cd /a", "ls -a"]), (3, ["cd /b", "ls -l"])])
    v = R.variant_keys(s, "seq", "earlier", "args")
    memo = s.select(R.sequence_key("earlier", "args").alias("key"), F.col("seq").alias("run_no"))
    todo = {r.key for r in R.pending_runs(v, memo).collect()}
    name = {(r.seq, r.dropped_pos): r.key for r in v.collect()}
    assert name[1, 1] not in todo and name[1, 2] in todo  # "ls -a" ran after cd /a, "ls -l" only after cd /b
    hits = R.memo_lookup(v.withColumn("req", F.concat_ws(":", "seq", "dropped_pos")), memo, "key", "req").collect()
    assert [(r.req, r.run_no) for r in hits] == [("1:1", 2)]


def test_words_that_differ_in_places_only(spark):
    """A Thue-Morse word and its complement as token sequences."""
    m = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, ["u " + " ".join("ab"[x] for x in m)]), (2, ["u " + " ".join("ba"[x] for x in m)])]
    s = sequences(spark, rows)
    assert s.select(R.sequence_key("earlier", "args")).distinct().count() == 2


def test_null_inputs_can_be_known(spark, tmp_path):
    new = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "seq long, input string")
    assert [r.seq for r in exclude_known_inputs(new, new.where("seq = 1")).orderBy("seq").collect()] == [2, 3]
    assert exclude_known_inputs(new, new.where("false")).count() == 3
    path = str(tmp_path / "registry")
    assert [save_registry(spark, new, path), save_registry(spark, new, path)] == [3, 0]
    assert load_registry(spark, path).count() == 3


def test_first_row_of_a_key_with_null_orders():
    class State:
        exists = False

        def update(self, _):
            self.exists = True
    first = J._first_unseen_fn("seq", ["input", "seq"])
    frames = [pd.DataFrame({"input": ["a", "a"], "seq": [None, None]}), pd.DataFrame({"input": ["a", "a"], "seq": [None, 4.0]}), pd.DataFrame({"input": ["a"], "seq": [3.0]})]
    assert [r["seq"].tolist() for r in first(("a",), frames, State())] == [[3.0]]
    only = list(first(("a",), frames[:1], State()))
    assert len(only) == 1 and only[0]["seq"].isna().all()
    assert list(first(("a",), [frames[1].iloc[:0]], State())) == []


def test_dedupe_stream_keeps_null_orders(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 5), ("b", None), (None, 1), (None, 2)], "input string, seq long")
    rows.write.json(str(tmp_path / "in"))
    J.stream_dedupe(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), rows.schema)
    got = {(r.input, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", None), ("b", 5), (None, 1)}


def test_directories_need_only_the_last_full_state(spark, tmp_path):
    import shutil
    r = random.Random(9)
    rows = [(s, k, r.choice(["cd a", "cd ..", "cd /b", "ls", "cd c"])) for k in range(42) for s in ("x", "y", None, f"s{k % 11}")]
    cols = "session string, ord long, cmd string"
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    for batch in range(7):
        df = spark.createDataFrame([x for x in rows if x[1] // 6 == batch and (x[0] != "y" or batch == 0)], cols)
        J.cwd_batch(df, plain, plain + "-state", batch, "session", "ord", "cmd", compact_every=1000)
        J.cwd_batch(df, packed, packed + "-state", batch, "session", "ord", "cmd", compact_every=2)
        if batch == 5:
            for old in range(4):  # batch 6 starts from the full state of batch 4
                shutil.rmtree(f"{packed}-state/batch={old}")
    out = lambda d: sorted(map(tuple, spark.read.parquet(d).select("batch", "session", "ord", "cwd_before", "cwd_after").collect()), key=str)
    assert out(plain) == out(packed)
    assert spark.read.parquet(f"{packed}-state/batch=4").where("session = 'y'").count() == 1


def test_watermark_expires_keys_and_drops_late_rows(spark, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    drops = [[("a", day(1)), ("a", day(1)), ("b", day(1))], [("a", day(2)), ("c", day(10))], [("b", day(3)), ("d", day(9)), ("c", day(10))], [("e", day(30))]]
    paths = [str(tmp_path / x) for x in ("in", "out", "ck")]
    held = []
    for rows in drops:
        df = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t"))
        df.write.mode("append").json(paths[0])
        held.append(J.stream_dedupe_watermark(spark, *paths, df.schema, ["k"], "t", "2 days"))
    got = sorted((r.k, str(r.t)) for r in spark.read.parquet(paths[1]).collect())
    # a again on day 2 is a copy; b on day 3 is late (watermark 8); c again is a copy
    assert got == [("a", day(1)), ("b", day(1)), ("c", day(10)), ("d", day(9)), ("e", day(30))]
    assert held[0] == 2 and held[-1] <= 2  # the keys of the first days have expired


def test_sums_of_a_row_come_before_its_tokens(spark):
    """Beside the generator they would be computed again for each token."""
    from tracefold.operators.redundancy import variant_keys
    df = spark.createDataFrame([(1, "e", ["a", "b", "c"])], "seq long, earlier string, args array<string>").repartition(2)
    plan = variant_keys(df, "seq", "earlier", "args")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate ", 1)
    assert "aggregate(" not in above and "aggregate(" in below
