"""Similarity against a threshold: the same decisions, fewer recurrences."""

import random

from pyspark.sql import functions as F

from tracefold.functions import similarity as S
from tracefold.operators import redundancy as R


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def pairs(seed, n=150):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(r.choice("abcdé ") for _ in range(r.randint(0, 200)))
        b = "".join(c for c in a if r.random() > 0.1) if r.random() < 0.4 else "".join(r.choice("abcxyz ") for _ in range(r.randint(0, 200)))
        out.append((a, b, r.choice([0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95, 1.0])))
    return out + [("", "", 0.5), ("", "a", 0.0), ("", "a", 0.2), (None, None, 1.0), (None, "a", 0.5), ("ab", "ba", 0.5), ("a" * 300, "a" * 299, 0.9), ("x", "x", None)]


def test_recurrence_with_an_early_end():
    for a, b, _ in pairs(1):
        if a and b:
            n = lcs(a, b)
            assert all(S.lcs_reaches(a, b, k) == (n >= k) for k in range(0, max(len(a), len(b)) + 2, 7))
            assert S.lcs_reaches(a, b, n) and not S.lcs_reaches(a, b, n + 1)


def test_same_decisions_and_most_without_python(spark):
    rows = pairs(2)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, a string, b string, beta double")
    got = {r["i"]: (r["hit"], r["sim"], r["known"]) for r in df.select(
        "i", S.similar_at_least("a", "b", "beta").alias("hit"), S.indel_similarity("a", "b").alias("sim"),
        S.threshold_bounds(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")), F.col("beta")).alias("known")).collect()}
    for i, (a, b, beta) in enumerate(rows):
        hit, sim, known = got[i]
        a, b = a or "", b or ""
        assert sim == (1.0 if a == b else 2.0 * lcs(a, b) / (len(a) + len(b)))
        assert hit == (None if beta is None else sim >= beta)
        assert known is None or known == (sim >= beta)
    assert sum(known is None for _, _, known in got.values()) < len(rows) / 2  # the rest never reaches Python


def test_variants_by_decision_and_by_known_pairs(spark):
    rows = [(k, n, a if n == 1 else b, n % 3 if k % 5 else 0) for k, (a, b, _) in enumerate(pairs(3, 30)[:30]) for n in (1, 2)]
    runs = spark.createDataFrame(rows, "k int, run_no int, output string, exit_code int")
    ref = runs.where("run_no = 1").withColumn("beta", F.lit(0.5))
    var = runs.where("run_no = 2")
    pick = lambda df: sorted((r["k"], r["code_match"], r["redundant"]) for r in df.collect())
    full = pick(R.variant_vs_reference(var, ref, "k"))
    assert full == pick(R.variant_vs_reference(var, ref, "k", sim=None))
    known = R.pairwise_run_similarity(runs, "k").where("run_i = 1").select("k", F.col("run_j").alias("run_no"), "sim")
    by_known = R.variant_vs_reference(var, ref, "k", known=known)
    assert full == pick(by_known) and "lcs" not in by_known.drop("sim")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
