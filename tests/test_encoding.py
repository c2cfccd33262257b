"""Longest-match encoding and in-row n-gram counts against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tracefold.functions.arrays import characters, common_count
from tracefold.operators import evaluation as E
from tracefold.operators import vocab as VO


def greedy(word, vocab, fallback=1):
    out, at, sizes = [], 0, sorted({len(t) for t in vocab}, reverse=True)
    while at < len(word):
        n = next((n for n in sizes if n <= len(word) - at and word[at: at + n] in vocab), 0)
        out.append(vocab.get(word[at: at + n], fallback) if n else fallback)
        at += max(n, 1)
    return out


def tables(spark, vocab, rows):
    return (spark.createDataFrame([(i, t) for i, t in rows], "id long, text string"),
            spark.createDataFrame(list(vocab.items()), "token string, id long"))


def check(spark, vocab, rows):
    df, v = tables(spark, vocab, rows)
    got = {r["id"]: r["ids"] for r in VO.encode_greedy(df, "text", v).collect()}
    assert got == {i: [x for w in (t or "").split() for x in ([vocab[w]] if w in vocab else greedy(w, vocab))] for i, t in rows}


def test_longest_match_equals_plain_search(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abé") for _ in range(r.randint(1, n)))
    for size in (3, 40, 300):
        tokens = sorted({word(17) for _ in range(size)})
        vocab = {t: k + 10 for k, t in enumerate(tokens)}
        rows = [(i, " ".join(word(60) for _ in range(4))) for i in range(60)] + [(900, None), (901, ""), (902, "  x  "), (903, tokens[0])]
        check(spark, vocab, rows)


def test_very_long_words_and_tokens(spark):
    r = random.Random(7)
    long = "".join(r.choice("ab") for _ in range(20_000))
    vocab = {long[:-1] + "x": 5, "ab": 6, "b": 7, long[:9000]: 8}
    check(spark, vocab, [(1, long), (2, "z" + long[:-1] + "x" + "ab"), (3, "z" * 20_000)])


def test_empty_vocabulary(spark):
    check(spark, {}, [(1, "ab c")])


def test_markers_hold_few_prefixes(spark):
    v = spark.createDataFrame([("a" * 13, 1), ("aaaaa", 2), ("b" * 8, 3)], "token string, id long")
    got = {(r.bit, len(r.prefix), r.prefix[0], r.n, r.tid) for r in VO.markers(v).collect()}
    assert got == {(3, 8, "a", 5, 2), (2, 12, "a", 5, 2), (0, 13, "a", 13, 1), (2, 4, "a", None, None), (0, 5, "a", 5, 2), (3, 8, "b", 8, 3)}


def test_clipped_counts(spark):
    r = random.Random(8)
    items = [([r.choice("abc") for _ in range(r.randint(0, 30))], [r.choice("abc") for _ in range(r.randint(0, 30))]) for _ in range(80)]
    df = spark.createDataFrame([(i, h, x) for i, (h, x) in enumerate(items)], "i int, h array<string>, r array<string>")
    df = E._grams(E._grams(df, "h", 4, "hg"), "r", 4, "rg")
    rows = df.select("i", *[common_count(f"hg{n}", f"rg{n}").alias(f"m{n}") for n in range(1, 5)]).collect()
    for row in rows:
        h, x = items[row["i"]]
        for n in range(1, 5):
            grams = lambda s: Counter(tuple(s[k: k + n]) for k in range(len(s) - n + 1))
            assert row[f"m{n}"] == sum((grams(h) & grams(x)).values())


def test_characters_are_code_points(spark):
    rows = spark.createDataFrame([("aé😀b",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(characters(F.col("t"))).collect()] == [["a", "é", "😀", "b"], [], []]


def test_null_sides_and_the_plan(spark):
    df = spark.createDataFrame([(1, "x", "a b c d", "a b c d"), (2, "x", None, "a"), (3, "x", "a", None), (4, "x", "", "")], "pid int, g string, p string, r string")
    assert E.sentence_bleu(df, "p", "r", ["pid"], ["g"]).first()["bleu"] == 0.25
    assert 0 < E.corpus_chrf(df, "p", "r", ["pid"], ["g"]).first()["chrf"] < 100
    plan = E.corpus_chrf(df, "p", "r", ["pid"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pid" not in plan
