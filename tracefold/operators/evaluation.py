"""Prediction metrics: smoothed sentence BLEU and corpus chrF++.

N-grams never leave their row.  An order's grams are hashes built from the
hashes of the order below and one more element; both sides' hashes are sorted
into one array with the side as the lowest bit, and one pass over its runs
counts the clipped matches.  So a pair costs O(n log n) and one row, nothing
is exploded and only per-order sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.arrays import characters, common_count
from tracefold.functions.text import WS_CLASS
from tracefold.operators.actions import words

# Fixed value: Python's string.punctuation (chrF word tokenisation).
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _grams(df: DataFrame, items: str, top: int, out: str) -> DataFrame:
    """Columns <out>1 .. <out><top>: 64-bit hashes of the n-grams of an array
    of strings, each from the hash of its first n-1 elements and its last."""
    df = df.withColumn(f"{out}1", F.transform(items, lambda x: F.xxhash64(x)))
    for n in range(2, top + 1):
        size = F.greatest(F.size(items) - (n - 1), F.lit(0))
        longer = F.zip_with(F.slice(f"{out}{n - 1}", F.lit(1), size), F.slice(items, F.lit(n), size), lambda h, x: F.xxhash64(h, x))
        df = df.withColumn(f"{out}{n}", longer)
    return df


def sentence_bleu(df: DataFrame, pred: str, ref: str, pid: list, by: list, k: float = 5.0) -> DataFrame:
    """Mean smoothed sentence BLEU (whitespace tokens, one reference,
    weights 1/4, smoothing method 4); an empty or null side scores 0.  A row
    is a pair, whatever its ``pid``."""
    none = F.array().cast("array<string>")
    s = df.select(*by, F.coalesce(words(pred), none).alias("_ht"), F.coalesce(words(ref), none).alias("_rt"))
    s = _grams(_grams(s, "_ht", 4, "_h"), "_rt", 4, "_r")
    s = s.select(*by, F.size("_ht").alias("_hl"), F.size("_rt").alias("_rl"), *[common_count(f"_h{n}", f"_r{n}").alias(str(n)) for n in range(1, 5)])
    hl = F.col("_hl").cast("double")
    logsum = F.lit(0.0)
    c = F.lit(1.0)  # smoothing counter: 1 + number of earlier smoothed orders
    for n in range(1, 5):
        mn = F.col(str(n)).cast("double")
        den = F.greatest(hl - n + 1, F.lit(1.0))
        smooth = (mn == 0) & (hl > 1)
        pn = F.when(smooth, (F.lit(1.0) / (F.pow(F.lit(2.0), c) * F.lit(k) / F.log(hl))) / den) \
              .otherwise(mn / den)
        logsum = logsum + F.when(pn > 0, F.lit(0.25) * F.log(pn)).otherwise(F.lit(0.0))
        c = c + F.when(smooth, F.lit(1.0)).otherwise(F.lit(0.0))
    rl = F.col("_rl").cast("double")
    bp = F.when(hl > rl, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - rl / hl))
    bleu = (F.when((F.col("_hl") == 0) | (F.col("_rl") == 0), F.lit(0.0))
             .when(F.col("1") == 0, F.lit(0.0))
             .otherwise(bp * F.exp(logsum)))
    per = s.withColumn("bleu", bleu)
    return per.groupBy(*by).agg((F.sum("bleu") / F.greatest(F.count("*"), F.lit(1))).alias("bleu"),
                                F.count("*").alias("n_pairs"))


def chrf_words(col) -> Column:
    """Whitespace tokens; a token longer than one character has one
    trailing (else leading) punctuation mark split off."""
    punct = F.array(*[F.lit(ch) for ch in PUNCT])

    def split_one(w):
        n = F.length(w)
        last, first = F.substring(w, -1, 1), F.substring(w, 1, 1)
        return (F.when(n == 1, F.array(w))
                 .when(F.array_contains(punct, last), F.array(w.substr(F.lit(1), n - 1), last))
                 .when(F.array_contains(punct, first), F.array(first, w.substr(F.lit(2), n)))
                 .otherwise(F.array(w)))
    return F.flatten(F.transform(words(col), split_one))


def corpus_chrf(df: DataFrame, pred: str, ref: str, pid: list, by: list, char_order: int = 6,
                word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """Corpus chrF++ (char order 6, word order 2, beta 2): per sentence
    and order, hyp count (only if the reference has n-grams of that
    order), ref count and clipped matches, summed over the corpus, then
    precision / recall averaged over effective orders."""
    none = F.array().cast("array<string>")
    nows = lambda c: characters(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), f"{WS_CLASS}+", ""))
    d = df.select(*by, nows(pred).alias("_hc"), nows(ref).alias("_rc"), F.coalesce(chrf_words(pred), none).alias("_hw"), F.coalesce(chrf_words(ref), none).alias("_rw"))
    d = _grams(_grams(d, "_hc", char_order, "_hcg"), "_rc", char_order, "_rcg")
    d = _grams(_grams(d, "_hw", word_order, "_hwg"), "_rw", word_order, "_rwg")
    items = []
    for kind, n in [("c", n) for n in range(1, char_order + 1)] + [("w", n) for n in range(1, word_order + 1)]:
        nh, nr = (F.greatest(F.size(f"_{side}{kind}") - n + 1, F.lit(0)) for side in "hr")
        items.append(F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.when(nr > 0, nh).otherwise(F.lit(0)).alias("nh"), nr.alias("nr"),
                              common_count(f"_h{kind}g{n}", f"_r{kind}g{n}").alias("m")))
    st = d.select(*by, F.array(*items).alias("_s")).select(*by, F.inline_outer("_s"))  # outer: no second copy of the counting in an inferred filter
    corp = st.groupBy(*by, "kind", "n").agg(F.sum("nh").alias("nh"), F.sum("nr").alias("nr"),
                                            F.sum("m").alias("m"))
    eps = 1e-16
    prec = F.when(F.col("nh") > 0, F.col("m") / F.col("nh")).otherwise(F.lit(eps))
    rec = F.when(F.col("nr") > 0, F.col("m") / F.col("nr")).otherwise(F.lit(eps))
    eff = ((F.col("nh") > 0) & (F.col("nr") > 0)).cast("int")
    agg = corp.groupBy(*by).agg(F.sum(prec).alias("_p"), F.sum(rec).alias("_r"), F.sum(eff).alias("_e"))
    p = F.when(F.col("_e") == 0, F.lit(0.0)).otherwise(F.col("_p") / F.col("_e"))
    r = F.when(F.col("_e") == 0, F.lit(0.0)).otherwise(F.col("_r") / F.col("_e"))
    f2 = beta * beta
    score = F.when(p + r > 0, 100.0 * (1 + f2) * p * r / (f2 * p + r)).otherwise(F.lit(0.0))
    return agg.select(*by, score.alias("chrf"))

