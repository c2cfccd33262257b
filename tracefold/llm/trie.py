"""Conversation prefix trie by van Emde Boas recursion.

Every distinct sequence of first d turns is a node.  The recursion works on
rows (conversation, position, turn hash) and never on whole conversations:

* **Cut.**  Positions are cut into blocks, first one block of 2**k
  positions; a block's first half is an upper trie, its second half a
  forest of lower tries.  A row is worked on only at the steps whose cut its
  conversation reaches, so a few long conversations cost the rest nothing.
* **Name.**  The upper half of a conversation is fingerprinted by a grouped
  xor of positioned turn hashes; equal fingerprints under one block root
  are one cut prefix, named by its smallest conversation.
* **Recurse.**  In the upper trie only the name's rows go on, with the
  weight of the whole class (a group of copies, however large, is one
  sequence from then on); in the lower forest every row goes on with the
  cut prefix as its root.  Both halves of all blocks are cut again in the
  next step, together; after k steps a block is one turn and a row's root
  is its parent.
* **Graft.**  Going up, blocks are joined in pairs: the totals of the lower
  tries of a cut prefix are added to the prefix and to its ancestors inside
  the upper trie.  The ancestors come from chains that double with the
  blocks; a chain starts at each inner node, so all chains of a step hold no
  more rows than the conversations have turns.

So a trie of depth D takes log2(D) steps of joins and grouped sums on narrow
rows; nothing is collected, and text is read once, for its hash and length.

The conversations that end at a node are hashed in the order of their ids:
rows are range-partitioned by (node, id), joined to chunks of IDS ids there,
and each node's chunks run through SHA-256 in order.  SHA-256 of one text is
sequential, so a node's chunks meet in one task, as a stream of n / IDS rows.

Defined results: rows without conv_id take no part; null role or text is
empty; turns with one number (null first) are ordered by role, then by the
SHA-256 of their text; repeated rows are turns of their own; ``%`` keeps the
sign of its left side; turns are compared by 120 bits of SHA-256, segments by
128 bits over these; an empty table gives no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import stored
from tracefold.operators.numbering import global_rank
from tracefold.session import scratch_path

#: Ids of one chunk row; heads of at most HEAD turns come from another conversation.
IDS, HEAD, GROUP = 256, 6, 100


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, t1, t2, chars): each turn's hash, place and length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda a: F.conv(F.substring("_h", a, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"),
                                                             F.sha2(text, 256).alias("_text"), whole.alias("_h"), F.char_length(text).cast("long").alias("chars"))
    rows = rows.select("conv_id", "_turn", "_role", "_text", part(1).alias("t1"), part(16).alias("t2"), "chars")
    ranked = global_rank(rows, ["_turn", "_role", "_text"], out="_n", group=["conv_id"], narrow=False)
    return ranked.select("conv_id", (F.col("_n") - 1).alias("pos"), "t1", "t2", "chars")


def rebuild(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from their group's first one:
    (conv_id, pos from 1, t1, t2, chars) and (conv_id, length)."""
    convs = t.groupBy("conv_id").agg(F.count("*").alias("_own"))
    convs = convs.select("conv_id", "_own", (F.crc32(F.col("conv_id").cast("string")) % HEAD).alias("_h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("_from"))
    base = convs.select(F.col("conv_id").alias("_from"), F.col("_own").alias("_there"))
    convs = convs.join(base, "_from", "left").select("conv_id", "_own", "_h", "_from", F.least("_h", F.coalesce("_there", F.lit(0))).alias("_take"))
    heads = t.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD)).withColumnRenamed("conv_id", "_from")
    heads = convs.join(heads, "_from").where("pos < _take").select("conv_id", (F.col("pos") + 1).alias("pos"), "t1", "t2", "chars")
    tails = t.join(convs, "conv_id").where("pos >= _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_take") + 1).alias("pos"), "t1", "t2", "chars")
    length = convs.select("conv_id", (F.col("_take") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("length"))
    return heads.unionByName(tails), length


def _half(half: int) -> tuple[Column, Column]:
    """(block, place inside it) of a position, for blocks of 2 * half."""
    at = F.col("pos") - 1
    return F.floor(at / (2 * half)).cast("long"), F.pmod(at, F.lit(2 * half))


def _by_level(rows: DataFrame) -> DataFrame:
    """Stored in folders by the step at which a sequence's first cut lies."""
    spark, rows = rows.sparkSession, rows.withColumn("level", F.length(F.bin("length")) - 1)
    path = scratch_path(spark, "trie-rows")
    rows.write.partitionBy("level").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def build(paths: DataFrame, length: DataFrame, root: int) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (conv_id, depth, parent, n_convs, chars) below the root, the ends
    (conv_id = the node's, depth, member) of all sequences, and the number of
    recursion steps.  ``paths``: (conv_id, pos from 1, t1, t2, chars)."""
    known = paths.join(length, "conv_id")
    keep = lambda d, end: d.select("conv_id", "pos", "t1", "t2", "chars", "length", F.lit(root).cast("long").alias("g"), F.lit(1).cast("long").alias("w"),
                                   F.col("length").alias("reach"), F.lit(end).alias("end"))
    begin = _by_level(keep(known, False).unionByName(keep(known.where("pos = length"), True)))
    deepest = length.agg(F.max("length")).first()[0] or 0
    steps = deepest.bit_length()
    ends = length.where("length = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    rows = begin.drop("level").where("false")
    for step in range(steps - 1, -1, -1):
        half = 1 << step
        rows = rows.unionByName(begin.where(F.col("level") == step).drop("level"))  # shorter sequences enter later
        block, at = _half(half)
        cut = rows.withColumn("block", block).withColumn("at", at)
        full = F.col("length") >= (2 * F.col("block") + 1) * half
        mark = lambda seed: F.bit_xor(F.xxhash64("at", "t1", "t2", F.lit(seed)))
        upper = (cut.where(full & ~F.col("end") & (F.col("at") < half)).groupBy("conv_id", "block")
                 .agg(mark(1).alias("f1"), mark(2).alias("f2"), F.max("g").alias("g"), F.max("w").alias("w"), F.max("reach").alias("reach")))
        classes = upper.groupBy("block", "g", "f1", "f2").agg(F.min("conv_id").alias("name"), F.sum("w").alias("total"), F.max("reach").alias("deepest"))
        named = upper.select("conv_id", "block", "g", "f1", "f2").join(classes, ["block", "g", "f1", "f2"]).select("conv_id", "block", "name", "total", "deepest")
        met = stored(cut.where(full).join(named, ["conv_id", "block"]), f"trie-cut-{half}")
        below = F.col("at") >= half
        ends = ends.unionByName(met.where(F.col("end") & ~below).select(F.col("name").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv_id").alias("member")))
        on = met.where(below | (~F.col("end") & (F.col("name") == F.col("conv_id"))))
        on = on.select("conv_id", "pos", "t1", "t2", "chars", "length", F.when(below, F.col("name")).otherwise(F.col("g")).alias("g"), F.when(below, F.col("w")).otherwise(F.col("total")).alias("w"),
                       F.when(below, F.col("reach")).otherwise(F.col("deepest")).alias("reach"), "end")
        rows = stored(on.unionByName(cut.where(~full).select(on.columns)), f"trie-rows-{half}")
    nodes = stored(rows.where(~F.col("end")).groupBy("pos", "g", "t1", "t2").agg(F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("chars").alias("chars"),
                                                                              F.max("reach").alias("reach")), "trie-nodes")
    left = rows.where("end").select("pos", "g", "t1", "t2", F.col("conv_id").alias("member")).join(nodes, ["pos", "g", "t1", "t2"])
    ends = ends.unionByName(left.select("conv_id", F.col("pos").alias("depth"), "member"))
    return nodes.select("conv_id", F.col("pos").alias("depth"), F.col("g").alias("parent"), "n_convs", "chars", "reach"), stored(ends, "trie-ends"), steps


def graft(nodes: DataFrame, steps: int, values: list[str]) -> DataFrame:
    """(conv_id, depth, values): each value summed over the node's subtree.
    A node leaves as soon as its subtree ends inside its block."""
    key = ["conv_id", "depth"]
    total = nodes.select(*key, "parent", "reach", *values)
    # chains: from inner node (conv_id, depth) up to (up, at), as far as the start of its block
    inner = nodes.where(F.col("reach") > F.col("depth"))
    chain = stored(inner.select(*key, F.col("conv_id").alias("up"), F.col("depth").alias("at"))
                   .unionByName(inner.select(*key, F.col("parent").alias("up"), (F.col("depth") - 1).alias("at"))), "trie-chain-1")
    done = None
    for step in range(steps):
        half = 1 << step
        ready = total.where(F.col("reach") <= half).select(*key, *values)
        done = ready if done is None else done.unionByName(ready)
        total = total.where(F.col("reach") > half)
        low = (total.where((F.col("depth") - 1) % (2 * half) == half).groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
               .agg(*[F.sum(v).alias(v) for v in values]))
        more = (low.join(chain.where(F.col("at") > F.col("depth") - half), key).groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
                .agg(*[F.sum(v).alias(f"_{v}") for v in values]))
        total = stored(total.join(more, key, "left").select(*key, "parent", "reach", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), f"trie-total-{half}")
        if step + 1 < steps:
            long = chain.where(F.col("depth") % (2 * half) == 0)
            link = long.where(F.col("at") == F.col("depth") - half).select(*key, F.col("up").alias("_c"), F.col("at").alias("_d"))
            far = link.join(chain.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "up", "at"), ["_c", "_d"]).select(*key, "up", "at")
            chain = stored(long.where(F.col("at") > F.col("depth") - half).unionByName(far), f"trie-chain-{2 * half}")
    rest = total.select(*key, *values)
    return rest if done is None else done.unionByName(rest)


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes where sequences end."""
    def chunks(batches):
        node, first, ids = None, None, []
        kept: list[tuple] = []

        def close():
            if ids:
                kept.append((*node, first, ",".join(map(str, ids))))
        for b in batches:
            for c, d, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (c, d) != node or len(ids) == IDS:
                    close()
                    node, first, ids = (c, d), m, []
                ids.append(m)
            if kept:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "first", "ids"), r)) for r in kept], schema=shape)
                kept.clear()
        close()
        if kept:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "first", "ids"), r)) for r in kept], schema=shape)

    def hashes(batches):
        node, state = None, None
        for b in batches:
            done = []
            for c, d, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (c, d) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), r)) for r in done], schema=result)
        if node:
            yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], schema=result)

    shape = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    result = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = ends.select("conv_id", "depth", "member").repartitionByRange(n, "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    parts = sorted_.mapInArrow(chunks, "conv_id long, depth long, first long, ids string")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashes, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations' trie: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    paths, length = rebuild(stored(turns(conversations), "trie-turns"))
    length = stored(length, "trie-length")
    root, count = length.agg(F.min("conv_id"), F.count("*")).first()
    if root is None:
        return length.select(*[F.lit(None).cast("long").alias(c) for c in names], F.lit("").alias("ends_sha256")).where("false")
    nodes, ends, steps = build(paths, length, root)
    children = nodes.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = stored(nodes.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent", "reach", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "trie-own")
    totals = graft(own, steps, ["n_leaves", "saved_tokens"])
    below = own.select("conv_id", "depth", "parent", "n_convs", "n_children").join(totals, ["conv_id", "depth"])
    below = below.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    top = own.agg(F.coalesce(F.sum((F.col("depth") == 1).cast("long")), F.lit(0)).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(1)), F.lit(1)).alias("n_leaves"),
                  F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    top = top.select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                     F.lit(count).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    out = top.unionByName(below).join(digests(ends), ["conv_id", "depth"], "left")
    return out.select(*names, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: CRC-32 (reflected, 0xEDB88320) of the decimal id, bit by bit.
_CRC = ("xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT))), "
        "lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, own, {_CRC} % 6 AS h, c - c % 100 AS b FROM (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS own FROM t GROUP BY c)),
k AS (SELECT n.c, n.own, n.h, n.b, least(n.h, coalesce(m.own, 0)) AS take FROM n LEFT JOIN n m ON m.c = n.b),
path AS (
  SELECT k.c, t.p + 1 AS d, t.role, t.text FROM k JOIN t ON t.c = k.b WHERE t.p < k.take
  UNION ALL SELECT k.c, t.p - k.h + k.take + 1, t.role, t.text FROM k JOIN t ON t.c = k.c WHERE t.p >= k.h),
pre AS (
  SELECT c, d, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key FROM path
  UNION ALL SELECT c, 0, 0, '' FROM k),
named AS (SELECT c, d, chars, min(c) OVER (PARTITION BY d, key) AS id, max(d) OVER (PARTITION BY c) AS len FROM pre),
node AS (SELECT id, d, count(*) AS n, any_value(chars) AS chars, string_agg(CASE WHEN len = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM named GROUP BY id, d),
up AS (SELECT node.*, a.id AS parent FROM node LEFT JOIN named a ON a.c = node.id AND a.d = node.d - 1),
kids AS (SELECT parent AS id, d - 1 AS d, count(*) AS kids FROM up WHERE d > 0 GROUP BY ALL),
own AS (SELECT up.*, coalesce(kids, 0) AS kids FROM up LEFT JOIN kids USING (id, d)),
total AS (SELECT a.id, a.d, sum(CASE WHEN o.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((o.n - 1) * o.chars) AS saved
          FROM own o JOIN named a ON a.c = o.id AND a.d <= o.d GROUP BY a.id, a.d)
SELECT o.id AS conv_id, CAST(o.d AS BIGINT) AS depth, o.parent AS parent_conv_id, o.n AS n_convs, CAST(o.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM own o JOIN total USING (id, d)"""
