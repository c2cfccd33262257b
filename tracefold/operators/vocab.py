"""Vocabulary, greedy sub-word encoding and decoding.  Words are encoded
natively; Arrow batches only put texts together from their words' ids.

Greedy longest-match encoding takes a word that is a token as it is.  For
the rest the longest token at each position comes from a binary search over
prefix lengths: a token marks its prefixes whose lengths are its own length
with low bits cleared (13: 8, 12, 13), and each marker knows the longest token
inside it.  A position asks for length 2**k, then adds 2**(k-1) or not, and so
on: one equi-join a bit, one row a position, however long the tokens are.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tracefold.functions.text import PLACEHOLDER, WS_CLASS, split_placeholders, py_strip
from tracefold.operators.actions import words
from tracefold.operators.numbering import global_rank
from tracefold.session import stored

SPECIALS = ["<pad>", "<cls>", "<unk>"]
PRINTABLE = list(string.printable)  # the 100 printable characters, in order


def build_vocabulary(grammar: DataFrame, dirs: DataFrame | None = None,
                     inventory: DataFrame | None = None) -> DataFrame:
    """token -> id.  Sections in order: specials, printable characters,
    literal pieces of productions (grammar order), '/'-parts of working
    directories (``dirs``: dir, ord), inventory values (``inventory``:
    value, ord; without ord in the order of their text).  First id wins for
    repeated tokens."""
    spark = grammar.sparkSession
    key = "struct<sec:int,s:string,a:bigint,b:bigint>"
    fixed = spark.createDataFrame(
        [(t, 0, i) for i, t in enumerate(SPECIALS)] + [(t, 1, i) for i, t in enumerate(PRINTABLE)],
        "token string, sec int, a long")
    parts = [fixed.select("token", F.struct(F.col("sec"), F.lit("").alias("s"), F.col("a"),
                                            F.lit(0).cast("long").alias("b")).cast(key).alias("k"))]
    simple = ~F.col("production").rlike(r"[\[" + WS_CLASS[1:])  # one piece, and no regex to find it
    whole = grammar.where(simple & (F.col("production") != "")).select("nonterminal", "ordinal", F.lit(0).alias("pos"), F.col("production").alias("token"))
    pieces = grammar.where(~simple).select("nonterminal", "ordinal", F.posexplode_outer(split_placeholders("production"))
                                           .alias("pos", "piece")) \
                    .select("nonterminal", "ordinal", "pos", py_strip(F.col("piece")).alias("token")) \
                    .where((F.col("token") != "") & ~F.col("token").rlike(PLACEHOLDER)).unionByName(whole)
    parts.append(pieces.select("token", F.struct(F.lit(2).alias("sec"), F.col("nonterminal").alias("s"),
                                                 F.col("ordinal").cast("long").alias("a"),
                                                 F.col("pos").cast("long").alias("b")).cast(key).alias("k")))
    if dirs is not None:
        dp = dirs.select("ord", F.posexplode(F.split("dir", "/")).alias("pos", "token"))
        parts.append(dp.select("token", F.struct(F.lit(3).alias("sec"), F.lit("").alias("s"),
                                                 F.col("ord").cast("long").alias("a"),
                                                 F.col("pos").cast("long").alias("b")).cast(key).alias("k")))
    if inventory is not None:
        ordered = "ord" in inventory.columns
        parts.append(inventory.select(F.col("value").alias("token"),
                                      F.struct(F.lit(4).alias("sec"), (F.lit("") if ordered else F.col("value")).alias("s"),
                                               (F.col("ord") if ordered else F.lit(0)).cast("long").alias("a"),
                                               F.lit(0).cast("long").alias("b")).cast(key).alias("k")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    first = stored(u.groupBy("token").agg(F.min("k").alias("k")).select("token", "k.*"), "vocabulary-keys")
    r = global_rank(first, ["sec", "s", "a", "b"], out="_r")
    return r.select("token", (F.col("_r") - 1).alias("id"))


#: Markers are broadcast up to this many bytes, joined by a shuffle beyond.
MARKER_BYTES = 32 << 20


def markers(vocab: DataFrame) -> DataFrame:
    """(bit, prefix, n, tid): every token's marked prefixes and the longest
    token (length, id) that each begins with; none: null."""
    t = vocab.where("token <> ''").select("token", "id", F.length("token").alias("_n"))
    bits = F.expr("filter(sequence(0, 30), k -> shiftright(_n, k) % 2 = 1)")
    m = t.select("token", "_n", F.explode(bits).alias("bit"))
    m = m.select("bit", F.expr("left(token, _n - _n % shiftleft(1, bit))").alias("prefix")).distinct()
    own = t.select(F.col("token").alias("prefix"), F.col("_n").alias("n"), F.col("id").alias("tid"))
    m = m.join(own, "prefix", "left")
    # a token inside a marker has some token's length; with L distinct lengths
    # the vocabulary holds at least L * L / 2 letters, so the list is short
    lengths = [r["_n"] for r in t.select("_n").distinct().collect()]
    sizes = F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>"), lambda x: x < F.length("prefix"))
    inner = m.where("tid is null").select("prefix", F.explode(sizes).alias("_l"))
    inner = inner.select("prefix", F.expr("left(prefix, _l)").alias("_t")).join(own.withColumnRenamed("prefix", "_t"), "_t")
    best = inner.groupBy("prefix").agg(F.max(F.struct("n", "tid")).alias("_b"))
    m = m.join(best, "prefix", "left")
    return m.select("bit", "prefix", F.coalesce("n", "_b.n").alias("n"), F.coalesce("tid", "_b.tid").alias("tid"))


def longest_matches(words_: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, i, n, tid): the longest token that begins at each position i
    (from 1) of each word; null where none does."""
    m = stored(markers(vocab), "markers")
    top, size = m.agg(F.max("bit"), F.sum(F.octet_length("prefix") + 24)).first()  # two scalars
    rows = words_.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    if top is None:
        return rows.select("word", "i", F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("tid"))
    # only as much of the word as a token may cover, and less after each bit
    rows = rows.select("word", "i", F.substring("word", F.col("i"), F.lit(2 ** (top + 1) - 1)).alias("_rest"), F.lit(0).alias("_l"),
                       F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("tid"))
    for k in range(top, -1, -1):
        level = m.where(F.col("bit") == k).select(F.col("prefix").alias("_p"), F.col("n").alias("_n"), F.col("tid").alias("_t"))
        level = F.broadcast(level) if size <= MARKER_BYTES else level
        ask = F.when(F.length("_rest") >= F.col("_l") + 2 ** k, F.expr(f"left(_rest, _l + {2 ** k})"))
        spread = F.concat(F.lit("\0"), F.col("i").cast("string"), F.lit("\0"), F.substring("word", 1, 16))  # meets nothing, and not all in one task
        rows = rows.withColumn("_ask", F.coalesce(ask, spread)).join(level, F.col("_ask") == F.col("_p"), "left")
        hit = F.col("_p").isNotNull()
        rows = rows.select("word", "i", F.when(hit, F.col("_l") + 2 ** k).otherwise(F.col("_l")).alias("_l"), "_rest",
                           F.when(hit, F.coalesce("_n", "n")).otherwise(F.col("n")).alias("n"), F.when(hit, F.coalesce("_t", "tid")).otherwise(F.col("tid")).alias("tid"))
        rows = rows.withColumn("_rest", F.expr(f"left(_rest, _l + {2 ** k - 1})"))
    return rows.select("word", "i", "n", "tid")


#: Rows meet their lexicon in chunks of about this many bytes.
CHUNK_BYTES, CHUNKS_LEAST = 16 << 20, 24


def _dealt(df: DataFrame, key: str, value, name: str) -> tuple[DataFrame, int]:
    """(key, value, chunk), stored: rows dealt by their key, so that the rows of
    one key meet; a row without a key has no value.  And the number of chunks."""
    rows = df.select(key, F.col(value).alias("_v"))
    size = F.octet_length("_v") if rows.schema["_v"].dataType == StringType() else F.size("_v") * 8
    held = stored(rows.withColumn("_size", size), name)
    total = held.agg(F.sum("_size")).first()[0] or 0  # a scalar
    n = max(CHUNKS_LEAST, -(-total // CHUNK_BYTES))
    spread = F.xxhash64(key, F.when(F.col(key).isNull(), F.col("_v")))
    return held.select(key, F.when(F.col(key).isNotNull(), F.col("_v")).alias("_v"), F.pmod(spread, F.lit(n)).alias("_chunk")), n


def encode_greedy(df: DataFrame, text: str, vocab: DataFrame, size: int | None = None, key: str = "id",
                  fallback: int = 1, out: str = "ids") -> DataFrame:
    """Per whitespace word: longest vocabulary substring from the left,
    repeatedly; a position with no hit gives ``fallback`` (1, as the
    reference does).  All ids of the whole text, or the first ``size - 1``.

    Each distinct word is encoded once.  Texts are dealt into chunks by their
    key; a chunk asks for the ids of its distinct words and puts its texts
    together from them, so no row a token is shuffled.  Rows of one key are
    one sequence: by word position, at equal positions by the ids."""
    rows, _ = _dealt(df, key, text, "encode-texts")
    asked = stored(rows.select("_chunk", F.explode_outer(F.array_distinct(words("_v"))).alias("word")).where("word is not null").distinct(), "encode-asked")
    every = stored(asked.select("word").distinct().join(vocab.withColumnRenamed("token", "word"), "word", "left"), "encode-words")
    exact = every.where("id is not null").select("word", F.array("id").alias("wids"))  # the longest hit is the word itself
    found = longest_matches(every.where("id is null").select("word"), vocab)
    per = found.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("i", "n", "tid"))).alias("at"))
    init = F.struct(F.lit(1).alias("cur"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        take = F.struct((x["i"] + F.coalesce(x["n"], F.lit(1))).alias("cur"),
                        F.concat(acc["ids"], F.array(F.coalesce(x["tid"], F.lit(fallback).cast("bigint")))).alias("ids"))
        return F.when(x["i"] == acc["cur"], take).otherwise(acc)

    enc = per.select("word", F.aggregate("at", init, step)["ids"].alias("wids"))
    lexicon = asked.join(enc.unionByName(exact), "word")
    kind, upto = df.schema[key].dataType, None if size is None else max(size - 1, 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids: dict = {}
        for w, x in zip(right.column("word").to_pylist(), right.column("wids").to_pylist()):
            ids.setdefault(w, []).append(x)
        several = any(len(x) > 1 for x in ids.values())
        flat = {} if several else {w: np.asarray(x[0], np.int64).tobytes() for w, x in ids.items()}

        def one(texts: list) -> np.ndarray:
            if len(texts) == 1 and not several:
                return np.frombuffer(b"".join([flat[w] for w in (texts[0] or "").split()]), np.int64)
            at = sorted((k, x) for t in texts for k, w in enumerate((t or "").split()) for x in ids[w])
            return np.array([i for _, x in at for i in x], np.int64)
        return _put_together(left, one, key, out, pa.int64(), upto)

    return rows.groupBy("_chunk").cogroup(lexicon.groupBy("_chunk")).applyInArrow(
        run, StructType([StructField(key, kind), StructField(out, ArrayType(LongType()))]))


def _put_together(left: pa.Table, one, key: str, out: str, kind: pa.DataType, upto: int | None = None) -> pa.Table:
    """Every row of a chunk with what ``one`` makes of all values of its key."""
    keys, values = left.column(key).to_pylist(), left.column("_v").to_pylist()
    of: dict = {}
    for k, v in zip(keys, values):
        of.setdefault(k, []).append(v)
    made = {k: (one([None]) if k is None else one(v)) for k, v in of.items()}
    if pa.types.is_string(kind):
        return pa.table([left.column(key), pa.array([made[k] for k in keys], kind)], names=[key, out])
    parts = [made[k][:upto] for k in keys]
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table([left.column(key), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))], names=[key, out])


def decode_ids(df: DataFrame, ids: str, vocab: DataFrame, key: str = "id", out: str = "text") -> DataFrame:
    """ids -> tokens joined by a space; 0 (pad) skipped; unknown -> <unk>.
    Chunks ask for the tokens of their distinct ids, as in ``encode_greedy``;
    rows of one key are one text, in the order of position and token."""
    rows, _ = _dealt(df, key, ids, "decode-ids")
    asked = stored(rows.select("_chunk", F.explode_outer(F.array_distinct("_v")).alias("tid")).where("tid <> 0").distinct(), "decode-asked")
    v = vocab.select(F.col("id").alias("tid"), "token")
    lexicon = asked.join(v, "tid", "left").withColumn("token", F.coalesce("token", F.lit("<unk>")))
    kind = df.schema[key].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens: dict = {}
        for i, t in zip(right.column("tid").to_pylist(), right.column("token").to_pylist()):
            tokens.setdefault(i, []).append(t)
        joined = {i: " ".join(sorted(t)) for i, t in tokens.items()}

        def one(rows_: list) -> str:
            if len(rows_) == 1:
                return " ".join([joined[i] for i in rows_[0] or [] if i])
            at = sorted((k, t) for r in rows_ for k, i in enumerate(r or []) if i for t in tokens[i])
            return " ".join(t for _, t in at)
        return _put_together(left, one, key, out, pa.string())

    return rows.groupBy("_chunk").cogroup(lexicon.groupBy("_chunk")).applyInArrow(
        run, StructType([StructField(key, kind), StructField(out, StringType())]))
