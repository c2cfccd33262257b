"""Golden and brute-force checks of single operators and quirks."""

import math
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from tracefold.functions import paths as P
from tracefold.functions import text as T
from tracefold.functions.similarity import indel_similarity, lcs_length
from tracefold.operators import numbering as N
from tracefold.operators import redundancy as R
from tracefold.operators import trajectories as TR
from tracefold.operators.sessions import cwd_track


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def test_lcs_bit_parallel_equals_dp(spark):
    rnd = random.Random(3)
    rows = [tuple("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 40))) for _ in range(2)) for _ in range(300)]
    rows += [("", ""), ("", "x"), ("abc", "abc"), ("ab", "ba"), (None, None), (None, "y"), ("x" * 9000 + "a", "b" + "x" * 9000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    got = {r.i: r.s for r in df.select("i", indel_similarity("a", "b").alias("s")).collect()}
    for i, (a, b) in enumerate(rows[:-1]):
        a, b = a or "", b or ""
        assert lcs_length(a, b) == lcs_dp(a, b)
        assert got[i] == pytest.approx(1.0 if a == b else 2 * lcs_dp(a, b) / (len(a) + len(b)))
    assert got[len(rows) - 1] == pytest.approx(2 * 9000 / 18002)  # whole texts, no prefix
    cut = df.where(f"i = {len(rows) - 1}").select(indel_similarity("a", "b", max_len=1).alias("s")).first()
    assert cut.s == 0.0


NORMALISED = [  # written by hand
    ("  Total 12345 KB \n\n x  y\t z", "total <num> kb\nx y z"), ("pid 999 and 1000\r\nDONE", "pid 999 and <num>\ndone"), ("", ""), (None, ""),
    ("a\x0bb\x1cc", "a\nb\nc"), ("é1234 5678x", "é1234 5678x"), ("<NUM>", "<num>"), ("line next 20000", "line next <num>"), (" \t\n \x85", "")]


def test_normalise_output(spark):
    df = spark.createDataFrame([(t,) for t, _ in NORMALISED], "t string")
    once = df.select(T.normalise_output("t").alias("t"))
    assert [r[0] for r in once.collect()] == [n for _, n in NORMALISED]
    assert [r[0] for r in once.select(T.normalise_output("t")).collect()] == [n for _, n in NORMALISED]  # idempotent


def test_similarity_chain_against_brute_force(spark):
    """Pairwise similarities and the noise threshold on a small fixture."""
    rows = [("k1", 1, "Files 12345 here\nok", 0), ("k1", 2, "files 99999 here\nOK", 0), ("k1", 3, "other", 0),
            ("k2", 1, "solo", 1)]
    runs = spark.createDataFrame(rows, "k string, run_no int, output string, exit_code int")
    sims = {(r.k, r.run_i, r.run_j): r.sim for r in R.pairwise_run_similarity(runs).collect()}
    norm = {("k1", 1): "files <num> here\nok", ("k1", 2): "files <num> here\nok", ("k1", 3): "other", ("k2", 1): "solo"}
    for (k, i, j), s in sims.items():
        a, b = norm[(k, i)], norm[(k, j)]
        exp = 1.0 if a == b else 2 * lcs_dp(a, b) / (len(a) + len(b))
        assert s == pytest.approx(exp)
    beta = {r.k: r for r in R.noise_threshold(runs, k=1.0).collect()}
    vals = [sims[("k1", 1, 2)], sims[("k1", 1, 3)], sims[("k1", 2, 3)]]
    m = sum(vals) / 3
    sd = math.sqrt(sum((v - m) ** 2 for v in vals) / 2)
    assert beta["k1"].beta0 == pytest.approx(max(0.2, m - sd))
    assert beta["k2"].beta0 == 1.0 and beta["k2"].beta == pytest.approx(0.95)


def test_split_placeholders_docstring(spark):
    df = spark.createDataFrame([("as[p1]df[p2] fdf[p3]pop",), ("a[b c[]d",)], "s string")
    got = [r[0] for r in df.select(T.split_placeholders("s")).collect()]
    assert got[0] == ["as", "[p1]", "df", "[p2]", " ", "fdf", "[p3]", "pop"]
    assert got[1] == ["a[b", " ", "c[]d"]


RESOLVED = [  # written by hand: (spec, cwd, result)
    ("~/x", "/a", "/root/x"), ("..", "/", "/"), ("~", "/a/b", "~"), ("", "/keep", "/keep"), ("../../..", "/a/b", "/"), ("./c/", "/a", "/a/c"),
    ("/x/./y/..", "/q", "/x"), ("~/..", "/z", "/"), ("a//b", "/r", "/r/a/b"), ("w", "~", "~/w"), ("..", "~/w", "~"), ("../..", "~/w", "/")]


def test_resolve_path_cases_and_random(spark):
    rnd = random.Random(1)
    cases = list(RESOLVED)
    for _ in range(200):  # without a home mark the rules are those of POSIX path normalisation
        spec = "/".join(rnd.choice(["a", "..", ".", "", "b"]) for _ in range(rnd.randint(1, 5)))
        spec = "/" + spec if rnd.random() < 0.3 else spec
        cwd = rnd.choice(["/", "/u/v"])
        if spec:
            cases.append((spec, cwd, "/" + posixpath.normpath(posixpath.join(cwd, spec)).lstrip("/")))
    df = spark.createDataFrame(cases, "spec string, cwd string, want string")
    for r in df.select("*", P.resolve_path("spec", "cwd").alias("got")).collect():
        assert r.got == r.want, r


def walk(cmds: list[str], cwd: str = "/") -> list[str]:
    """Directory after each command, for commands that POSIX rules cover."""
    out = []
    for c in cmds:
        if c.startswith("cd "):
            cwd = "/" + posixpath.normpath(posixpath.join(cwd, c[3:])).lstrip("/")
        out.append(cwd)
    return out


def session_rows(n: int = 37):
    rnd = random.Random(7)
    return [(s, i, rnd.choice(["cd ..", "cd x", "ls -l", "cd /a/b", "cd ../y/./z", "pwd", "cd ."])) for s in ["s1", "s2", None] for i in range(n)]


def check_walk(rows, got):
    for s in {r[0] for r in rows}:
        after = walk([c for k, _, c in sorted(rows, key=lambda r: r[1]) if k == s])
        assert [got[s, i] for i in range(len(after))] == list(zip(["/"] + after, after))


def test_cwd_track_multi_block(spark):
    rows = session_rows()
    df = spark.createDataFrame(rows, "session string, ord long, cmd string")
    check_walk(rows, {(r.session, r.ord): (r.cwd_before, r.cwd_after) for r in cwd_track(df, "session", "ord", "cmd", block=4).collect()})
    home = spark.createDataFrame([("h", 0, "cd ~"), ("h", 1, "cd q"), ("h", 2, "cd ~/w"), ("h", 3, "cd")], "session string, ord long, cmd string")
    assert [r.cwd_after for r in cwd_track(home, "session", "ord", "cmd", block=2).orderBy("ord").collect()] == ["~", "~/q", "/root/w", "/root/w/cd"]


@pytest.mark.parametrize("block", [2, 5])
@pytest.mark.parametrize("gamma", [0.0, 0.5, 0.99, 1.0])
def test_discounted_return_multi_block(spark, gamma, block):
    rnd = random.Random(5)
    rows = [(e, t, rnd.uniform(-1, 1)) for e in range(3) for t in range(23)]
    df = spark.createDataFrame(rows, "episode_id long, t long, reward double")
    from tracefold.operators.numbering import reverse_discounted_sum
    got = {(r.episode_id, r.t): r.G for r in reverse_discounted_sum(df, ["episode_id"], "t", "reward", gamma, block=block).collect()}
    for e in range(3):
        g = 0.0
        for t in reversed(range(23)):
            g = rows[e * 23 + t][2] + gamma * g
            assert got[(e, t)] == pytest.approx(g, abs=1e-9)


def test_global_rank_and_prefix_sum(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 5), rnd.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    r = {x.id: x.rn for x in N.global_rank(df, ["id"], out="rn").collect()}
    assert r == {i: i + 1 for i in range(300)}
    rg = {x.id: x.rn for x in N.global_rank(df, ["id"], out="rn", group=["g"]).collect()}
    for g in range(6):
        ids = sorted(i for i, gg, _ in rows if gg == g)
        assert [rg[i] for i in ids] == list(range(1, len(ids) + 1))
    p = {x.id: x.prefix for x in N.prefix_sum(df, ["id"], "v").collect()}
    acc = 0
    for i, _, v in rows:
        assert p[i] == acc
        acc += v


def test_human_format(spark):
    df = spark.createDataFrame([(20000,), (999,), (1000,), (2500000,)], "n long")
    assert [r[0] for r in df.select(T.human_format("n")).collect()] == ["20K", "999", "1K", "2M"]


def test_leave_one_out_guard(spark):
    df = spark.createDataFrame([(1, ["ls"]), (2, ["ls", "-l", "-a"])], "id int, args array<string>")
    got = sorted((r.id, r.dropped_pos, tuple(r.variant)) for r in R.leave_one_out(df).collect())
    assert got == [(2, 1, ("ls", "-a")), (2, 2, ("ls", "-l"))]


def test_first_good_attempt_quirk(spark):
    df = spark.createDataFrame([("a", 1, -1), ("a", 2, -1), ("a", 3, 0), ("b", 1, -1), ("b", 2, 0)],
                               "k string, attempt int, exit_code int")
    strict = {r.k: r.status for r in TR.first_good_attempt(df, "k", strict_reference=True).collect()}
    loose = {r.k: r.status for r in TR.first_good_attempt(df, "k", strict_reference=False).collect()}
    assert strict == {"a": "limit", "b": "ok"} and loose == {"a": "ok", "b": "ok"}


def test_context_compare_order(spark):
    df = spark.createDataFrame([
        ({"pwd": "/a", "ls": "x"}, {"pwd": "/b"}),           # difference before missing key wins
        ({"pwd": "/a", "ls": "x"}, {"pwd": "/a"}),           # missing key -> error
        ({"env": "A=1\nOLDPWD=/x"}, {"env": "A=1\nOLDPWD=/y"}),  # dynamic env ignored
        ({}, {"pwd": "/z"}),                                 # empty baseline equals everything
    ], "b map<string,string>, a map<string,string>")
    got = [(r.c.same, r.c.key) for r in df.select(R.context_compare(F.col("b"), F.col("a")).alias("c")).collect()]
    assert got == [(False, "pwd"), (True, "error"), (True, "none"), (True, "none")]


def test_bleu_and_chrf_identity(spark):
    from tracefold.operators.evaluation import corpus_chrf, sentence_bleu
    df = spark.createDataFrame([(1, "g", "the cat sat on the mat", "the cat sat on the mat"),
                                (2, "g", "", "x y")], "pid int, g string, pred string, ref string")
    b = sentence_bleu(df, "pred", "ref", ["pid"], ["g"]).first()
    assert b.bleu == pytest.approx(0.5)  # (1.0 + 0.0) / 2
    c = corpus_chrf(df.where("pid = 1"), "pred", "ref", ["pid"], ["g"]).first()
    assert c.chrf == pytest.approx(100.0)


def test_bleu_method4_hand_worked(spark):
    """hyp 'a b c d', ref 'a b e f g': p1 = 2/4, p2 = 1/3, p3, p4 smoothed
    with 1/(2^c * 5/ln 4) / denominator; brevity penalty exp(1 - 5/4)."""
    from tracefold.operators.evaluation import sentence_bleu
    df = spark.createDataFrame([(1, "g", "a b c d", "a b e f g")], "pid int, g string, pred string, ref string")
    got = sentence_bleu(df, "pred", "ref", ["pid"], ["g"]).first().bleu
    p = [2 / 4, 1 / 3, (1 / (2 * 5 / math.log(4))) / 2, (1 / (4 * 5 / math.log(4))) / 1]
    exp = math.exp(1 - 5 / 4) * math.exp(sum(0.25 * math.log(x) for x in p))
    assert got == pytest.approx(exp)


def test_derive_commands_tiny_grammar(spark):
    from tracefold.operators.derive import derive_commands
    g = spark.createDataFrame([
        ("[Input]", 0, "[ls]"), ("[Input]", 1, "[cat]"),
        ("[ls]", 0, "ls [lsOptions]"), ("[cat]", 0, "cat [File]"),
        ("[lsOptions]", 0, "-l"), ("[lsOptions]", 1, "-a"), ("[lsOptions]", 2, "-n [SmallNumber]"),
    ], "nonterminal string, ordinal int, production string")
    rep = spark.createDataFrame([("[lsOptions]",)], "nonterminal string")
    req = spark.range(200).select(F.col("id"), F.lit(3).alias("seed"))
    a = derive_commands(g, req, rep, max_args=3).collect()
    b = derive_commands(g, req, rep, max_args=3).collect()
    assert sorted(a) == sorted(b) and len(a) == 200    # seeded: deterministic
    for r in a:
        assert not re.search(r"\[[a-zA-Z0-9]+\]", r.command)
        assert r.n_args <= 3 and r.command == " ".join(r.args)
        assert re.fullmatch(r"ls( (-l|-a|-n [1-9]))*|cat \w{1,8}", r.command), r.command
        assert r.args[0] in ("ls", "cat") and len(r.args) == 1 + (r.n_args if r.args[0] == "ls" else 1)
    assert {r.command.split(" ")[0] for r in a} == {"ls", "cat"}
    inv = spark.createDataFrame([("img", "/w", "[File]", f) for f in ("x.txt", "y.txt")], "image string, cwd string, placeholder string, value string")
    at = req.withColumn("image", F.lit("img")).withColumn("cwd", F.when(F.col("id") % 2 == 0, F.lit("/w")).otherwise(F.lit("/none")))
    filled = derive_commands(g, at, rep, max_args=3, inventory=inv).collect()
    cats = [r for r in filled if r.args[0] == "cat"]
    assert {r.args[1] for r in cats if r.id % 2 == 0} == {"x.txt", "y.txt"}
    assert all(re.fullmatch(r"\w{1,8}", r.args[1]) for r in cats if r.id % 2)  # nothing there: random
    assert sorted((r.id, r.command) for r in filled if r.args[0] == "ls") == sorted((r.id, r.command) for r in a if r.args[0] == "ls")
    short = derive_commands(g, req, rep, max_args=30, early_stop=2).collect()
    long = derive_commands(g, req, rep, max_args=30).collect()
    assert sum(r.n_args for r in short) < sum(r.n_args for r in long)


def _undo_last_commit(checkpoint: str):
    """What a crash leaves that hits after a batch's write, before its commit."""
    import glob
    import os
    done = [p for p in glob.glob(f"{checkpoint}/commits/*") if os.path.basename(p).isdigit()]
    last = max(done, key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_stream_flush_replay(spark, tmp_path):
    """A batch that was written but not committed is replayed after the
    restart: same rows, same registry."""
    from tracefold.streaming.jobs import stream_flush
    src, out, reg, ck = (str(tmp_path / n) for n in ("in", "out", "reg", "ck"))
    schema = "seq long, input string"
    spark.createDataFrame([("seen",)], "input string").write.parquet(f"{reg}/flush=seed")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "seen")], schema).write.mode("append").json(src)
    run = lambda: stream_flush(spark, src, out, reg, ck, spark.createDataFrame([], schema).schema)
    rows = lambda: (sorted(tuple(r) for r in spark.read.parquet(out).select("input", "seq").collect()),
                    sorted(r[0] for r in spark.read.parquet(reg).select("input").collect()))
    run()
    assert rows() == ([("a", 1), ("b", 3)], ["a", "b", "seen"])
    _undo_last_commit(ck)
    run()
    assert rows() == ([("a", 1), ("b", 3)], ["a", "b", "seen"])
    spark.createDataFrame([(5, "a"), (6, "c")], schema).write.mode("append").json(src)
    run()
    _undo_last_commit(ck)
    run()
    assert rows() == ([("a", 1), ("b", 3), ("c", 6)], ["a", "b", "c", "seen"])
    # another query with its own checkpoint leaves the earlier partitions alone
    stream_flush(spark, src, out + "2", reg, ck + "2", spark.createDataFrame([], schema).schema)
    assert rows()[1] == ["a", "b", "c", "seen"]


def test_stream_cwd_over_batches_and_replay(spark, tmp_path):
    from tracefold.streaming.jobs import stream_cwd
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = session_rows()
    schema = spark.createDataFrame([], "session string, ord long, cmd string").schema
    for k in range(3):
        part = [r for r in rows if r[1] * 3 // 37 == k]
        spark.createDataFrame(part, schema).write.mode("append").json(src)
        stream_cwd(spark, src, out, ck, schema)
        if k:
            _undo_last_commit(ck)
            stream_cwd(spark, src, out, ck, schema)
    check_walk(rows, {(r.session, r.ord): (r.cwd_before, r.cwd_after) for r in spark.read.parquet(out).collect()})


def test_null_keys_keep_their_rows(spark):
    from tracefold.operators import curation as C
    rows = [("g", 1, 2.0, "x"), ("g", 2, 4.0, "y"), (None, 3, 1.0, "x"), (None, 4, 3.0, None), (None, None, 5.0, None)]
    df = spark.createDataFrame(rows, "g string, t long, v double, input string")
    assert N.global_rank(df, ["t"], out="rn", group=["g"]).count() == 5
    ranked = {(r.g, r.t): r.rn for r in N.global_rank(df, ["t"], out="rn", group=["g"]).collect()}
    assert ranked == {("g", 1): 1, ("g", 2): 2, (None, None): 1, (None, 3): 2, (None, 4): 3}
    scan = {(r.g, r.t): r.s for r in N.grouped_scan(df, ["g"], ["t"], "v", out="s").collect()}
    assert scan == {("g", 1): 2.0, ("g", 2): 6.0, (None, None): 5.0, (None, 3): 6.0, (None, 4): 9.0}
    z = {(r.g, r.t): r.v_std for r in TR.standardize_group(df, "v", ["g"]).collect()}
    assert len(z) == 5 and z[None, 4] == pytest.approx(0.0)
    d = df.withColumn("seq", F.coalesce("t", F.lit(9))).withColumnRenamed("g", "session")
    kept = {(r.input, r.seq): r.session_id for r in C.dedupe_traces(d).collect()}
    assert kept == {("x", 1): 1, ("y", 2): 1, (None, 4): 2}
    assert C.split_80_10_10(d, "seq", "session").count() == 5
    assert TR.next_value(d, "session", "t", "v").count() == 5


def test_integer_scans_are_exact(spark):
    big = 2**53
    df = spark.createDataFrame([("a", 1, big), ("a", 2, 1), ("a", 3, 1), ("b", 1, None), ("b", 2, big + 1)], "g string, t long, v long")
    assert [r.s for r in N.grouped_scan(df, ["g"], ["t"], "v", out="s").orderBy("g", "t").collect()] == [big, big + 1, big + 2, 0, big + 1]
    assert [r.s for r in N.grouped_scan(df, ["g"], ["t"], "v", op="max", out="s").orderBy("g", "t").collect()] == [big, big, big, None, big + 1]


def test_registry_faults_are_raised(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from tracefold.sources import traces_io as IO
    assert IO.load_registry(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(AnalysisException):
        IO.load_registry(spark, str(tmp_path / "wrong"))


@pytest.mark.parametrize("op", ["sum", "max"])
def test_grouped_scan_hot_group_spans_partitions(spark, op):
    """One group holding most rows is split over every range partition; the
    per-partition carries must stitch the running value back together."""
    rnd = random.Random(11)
    rows = [("hot", i, (rnd.randint(0, 50) if rnd.random() < 0.7 else None)) for i in range(900)]
    rows += [("cold", i, rnd.randint(0, 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    got = {(r.g, r.t): r.s for r in N.grouped_scan(df, ["g"], ["t"], "v", op=op, out="s").collect()}
    for g in ("hot", "cold"):
        acc = None
        for gg, t, v in rows:
            if gg != g:
                continue
            if op == "sum":
                acc = (acc or 0) + (v or 0)
            elif v is not None:
                acc = v if acc is None else max(acc, v)
            assert got[(g, t)] == (pytest.approx(acc) if acc is not None else None), (g, t)


def test_reference_file_forms(spark, tmp_path):
    """An episode log as one indented JSON array; a grammar as one JSON
    object, and as chunked lines."""
    from tracefold.operators import grammar as G
    from tracefold.sources import traces_io as IO
    log = tmp_path / "log.json"
    log.write_text('[\n  {"episode": 1, "step": 10},\n  {"episode": 3, "step": 44},\n  {"episode": 2, "step": 25}\n]')
    back = IO.read_episode_log(spark, str(log), multi_line=True, schema=spark.createDataFrame([], "episode long, step long").schema)
    assert tuple(IO.resume_point(back).first()) == (3, 3, 44)
    assert IO.read_episode_log(spark, str(tmp_path / "none"), schema=back.schema).count() == 0
    (tmp_path / "g.json").write_text('{"[Input]": ["[x]"], "[ls]": ["ls [lsOptions]", "ls"], "[lsOptions]": ["-a"]}')
    commands = spark.createDataFrame([(0, "[ls]")], "ordinal int, production string")
    g = G.read_grammar(spark, str(tmp_path / "g.json"), commands=commands, fmt="object")
    want = [("[Command]", 0, "[ls]"), ("[Input]", 0, "[ls]"), ("[ls]", 0, "ls [lsOptions]"), ("[ls]", 1, "ls"), ("[lsOptions]", 0, "-a")]
    assert sorted(map(tuple, g.collect())) == sorted(want)
    G.write_grammar(g, str(tmp_path / "lines"), chunk=1)
    assert sorted(map(tuple, G.read_grammar(spark, str(tmp_path / "lines")).collect())) == sorted(want)


def test_commands_without_variants_have_a_score(spark):
    compared = spark.createDataFrame([("a", True), ("a", False), ("a", None)], "k string, redundant boolean")
    refs = spark.createDataFrame([("a",), ("bare",)], "k string")
    got = {r.k: (r.n_args, r.n_redundant, r.output_redundancy_score) for r in R.output_redundancy(compared, "k", refs).collect()}
    assert got == {"a": (3, 1, pytest.approx(2 / 3)), "bare": (0, 0, 0.5)}


def test_encode_whole_text(spark):
    from tracefold.operators.vocab import decode_ids, encode_greedy
    v = spark.createDataFrame([("<pad>", 0), ("<cls>", 1), ("<unk>", 2), ("ab", 3), ("a", 4), ("b", 5), ("abc", 6)], "token string, id long")
    df = spark.createDataFrame([(1, "ab " * 300 + "abab xaz"), (2, ""), (3, None)], "id int, t string")
    e = encode_greedy(df, "t", v)
    got = {r.id: r.ids for r in e.collect()}
    assert got == {1: [3] * 300 + [3, 3, 1, 4, 1], 2: [], 3: []}
    assert {r.id: r.text for r in decode_ids(e, "ids", v).collect()} == {1: "ab " * 302 + "<cls> a <cls>", 2: "", 3: ""}
    assert {r.id: len(r.ids) for r in encode_greedy(df, "t", v, size=128).collect()} == {1: 127, 2: 0, 3: 0}


def test_mask_membership(spark):
    from tracefold.operators import grammar as G
    g = spark.createDataFrame([("[Input]", 0, "[ls]"), ("[ls]", 0, "ls [lsOptions]"), ("[lsOptions]", 0, "-a"), ("[lsOptions]", 1, "-b")],
                              "nonterminal string, ordinal int, production string")
    rep = spark.createDataFrame([("[lsOptions]",)], "nonterminal string")
    acts = G.production_actions(g, G.reachable_nonterminals(g))
    mask = G.production_mask_2layer(g, acts, G.expansion_heads(g), rep, strict_reference=False)
    n = acts.count()
    rows = {r.head: r for r in mask.collect()}
    assert not rows["[Input]"].allows_free and rows["[lsOptions]"].allows_free and rows["[lsOptions]"].allows_terminal
    taken = {a for r in rows.values() for a in r.own_actions}  # of the starting heads
    reserved = spark.createDataFrame([(a,) for a in sorted(taken)], "action_id long")
    ask = spark.createDataFrame([(h, a) for h in [*rows, "[none]"] for a in range(n + 2)], "head string, action_id long")
    got = {}
    for r in G.mask_allows(mask, ask, acts, reserved, n).collect():
        got.setdefault(r.head, set()).update([r.action_id] if r.allowed else [])
    for h, r in rows.items():
        free = set(range(n)) - taken if r.allows_free else set()
        assert got[h] == set(r.own_actions) | free | ({n} if r.allows_terminal else set()) and len(got[h]) == r.n_allowed
    assert got["[none]"] == set()
