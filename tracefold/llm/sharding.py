"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits.  The directory starts with one bucket; a
bucket over the byte limit is split on its next hash bit, and only such
buckets, until every shard fits.  One round settles up to eight bits: the
rows still in oversized buckets are summed by the deeper prefix, and a
bucket's shard is the shallowest prefix that fits.  Rounds repeat only for
rows of buckets that are still too large.

A bucket whose rows all share one hash (repeated keys) can't be split by
bits.  Its rows are dealt in order of a stored row number into overflow
shards by their running byte offset: the sums are taken per stored partition
first, so no task holds such a bucket whole.

Defined results: a null text counts 0 bytes, a null key hashes as ''; an
empty table gives no rows; a single row over the limit is a shard of its
own.  Further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import bounded, stored

HASH_BITS = 60
ROUND_BITS = 8


def key_hash(key):
    """First 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: int):
    return F.shiftright(F.col("_h"), HASH_BITS - depth)


def _directory(active: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """Per prefix of ``depth`` bits: the shallowest depth in (base, depth]
    whose bucket fits (null: none), and that bucket's sums."""
    cells = active.groupBy(_prefix(depth).alias("_cell")).agg(
        F.sum("n_bytes").alias("_b"), F.count("*").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    cells = cells.repartition(F.shiftright("_cell", depth - base).alias("_base"))
    found = {c: F.lit(None).cast("long") for c in ("_depth", "_bytes", "_rows")}
    first = 0 if base == 0 else base + 1
    for d in range(depth, first - 1, -1):
        w = Window.partitionBy(F.shiftright("_cell", depth - base), F.shiftright("_cell", depth - d))
        total = F.sum("_b").over(w)
        fits = total <= limit
        found = {"_depth": F.when(fits, F.lit(d).cast("long")).otherwise(found["_depth"]),
                 "_bytes": F.when(fits, total).otherwise(found["_bytes"]),
                 "_rows": F.when(fits, F.sum("_n").over(w)).otherwise(found["_rows"])}
    return cells.select("_cell", *[e.alias(c) for c, e in found.items()],
                        ((F.col("_lo") == F.col("_hi")) if depth < HASH_BITS else F.lit(True)).alias("_one"))


def _shard_rows(df: DataFrame, name) -> DataFrame:
    return df.select("doc_id", "n_bytes", F.col("_depth").cast("int").alias("depth"), name.alias("shard"),
                     F.col("_bytes").alias("shard_bytes"), F.col("_rows").alias("shard_docs"))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Deal rows of equal hash into slots that fit the limit."""
    part = F.shiftright("_row", 33)
    sums = rows.groupBy("_h", part.alias("_part")).agg(F.sum("n_bytes").alias("_s"), F.max("n_bytes").alias("_m"))
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_h", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"),
                       F.max("_m").over(Window.partitionBy("_h")).alias("_max"))
    run = Window.partitionBy("_h", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    at = (rows.withColumn("_part", part).join(sums, ["_h", "_part"])
          .withColumn("_at", F.col("_off") + F.coalesce(F.sum("n_bytes").over(run), F.lit(0))))
    # a row starts in slot k if its offset lies in [k*c, (k+1)*c); c leaves room for the row that straddles
    slot = F.floor(F.col("_at") / F.greatest(F.lit(limit) - F.col("_max") + 1, F.lit(1))).cast("long")
    at = at.withColumn("_slot", slot).withColumn("_depth", F.lit(HASH_BITS))
    size = at.groupBy("_h", "_slot").agg(F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows"))
    return _shard_rows(at.join(size, ["_h", "_slot"]), F.concat_ws(".", F.expr(f"lpad(bin(_h), {HASH_BITS}, '0')"), F.col("_slot").cast("string")))


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, depth, shard (its hash bits; '' is the
    undivided table), shard_bytes and shard_docs."""
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"))
    active = stored(rows.withColumn("_h", key_hash(F.col("doc_id"))).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    out, base = None, 0
    while True:
        depth = min(base + ROUND_BITS, HASH_BITS)
        directory = stored(_directory(active, base, depth, limit), "shard-directory")
        found = active.withColumn("_cell", _prefix(depth)).join(bounded(directory), "_cell")
        bits = F.expr(f"substring(lpad(bin(_h), {HASH_BITS}, '0'), 1, int(_depth))")
        parts = [_shard_rows(found.where("_depth is not null"), bits)]
        over = directory.where("_depth is null").groupBy("_one").count().collect()  # two rows at most
        left = {r["_one"]: r["count"] for r in over}
        if left.get(True):
            parts.append(_overflow(found.where("_depth is null and _one").select("doc_id", "n_bytes", "_h", "_row"), limit))
        for p in parts:
            out = p if out is None else out.unionByName(p)
        if not left.get(False):
            return out
        active = stored(found.where("_depth is null and not _one").select("doc_id", "n_bytes", "_h", "_row"), "shard-active")
        base = depth


def oracle(limit: int, depth: int = 24) -> str:
    """DuckDB: sums of every prefix up to ``depth`` bits, then the shallowest that fits."""
    return f"""
    WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, row_number() OVER () AS r,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
    lv AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes)::BIGINT AS b, count(*)::BIGINT AS c FROM h, range(0, {depth + 1}) t(d) GROUP BY ALL),
    hit AS (SELECT r, min(d) AS d FROM h JOIN lv ON lv.p = h.h >> (60 - lv.d) WHERE b <= {limit} GROUP BY r)
    SELECT h.doc_id, h.n_bytes, hit.d::INTEGER AS depth, lpad(to_base(h.h, 2), 60, '0')[1:hit.d] AS shard,
           lv.b AS shard_bytes, lv.c AS shard_docs
    FROM h JOIN hit USING (r) JOIN lv ON lv.d = hit.d AND lv.p = h.h >> (60 - hit.d)"""
