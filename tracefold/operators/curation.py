"""Dataset curation: registry exclusion, first-wins dedupe, seeded
splits, pooled test set, caps and uniform picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.nullsafe import join_same


def exclude_known_inputs(new: DataFrame, registry: DataFrame, key: str = "input") -> DataFrame:
    """Drop rows whose key is in the registry (a null key is a key like any
    other).  Only the keys' SHA-256 meet, so registered texts never move."""
    digest = F.sha2(F.col(key).cast("string"), 256).alias("_k")
    return join_same(new.select("*", digest), registry.select(digest).distinct(), ["_k"], "left_anti").drop("_k")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key (``order`` is unique).
    Only the key's SHA-256 and the order are aggregated; the winners' rows
    are then picked by their order value, so whole texts are neither sorted
    nor moved as keys."""
    first = df.groupBy(F.sha2(F.col(key).cast("string"), 256).alias("_k")).agg(F.min(order).alias(order)).select(order)
    return join_same(df, first, [order], "left_semi")


def dedupe_traces(df: DataFrame, key: str = "input", order: str = "seq", session: str = "session",
                  registry: DataFrame | None = None) -> DataFrame:
    """First occurrence of ``key`` in ``order`` wins (a partial minimum per
    key, joined back).  Sessions are numbered in order of their first row,
    counting only sessions that kept at least one row."""
    from tracefold.operators.numbering import global_rank
    src = df if registry is None else exclude_known_inputs(df, registry, key)
    kept = first_per_key(src, key, order)
    first = df.groupBy(session).agg(F.min(order).alias("_first"))
    contributing = join_same(first, kept.select(session).distinct(), [session], "left_semi")
    ids = global_rank(contributing, ["_first", session], out="session_id").drop("_first")
    return join_same(kept, ids, [session])


def split_80_10_10(df: DataFrame, key: str, by: str, seed: int = 1, test_frac: float = 0.2) -> DataFrame:
    """Seeded shuffle per group (md5 order), first ceil(test_frac * n) rows
    form the evaluation part, which a second seeded shuffle cuts into
    test (first ceil(half)) and validation; the rest is train."""
    from tracefold.operators.numbering import global_rank
    h1 = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("a"), F.col(key).cast("string")))
    h2 = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("b"), F.col(key).cast("string")))
    d = df.withColumn("_h1", h1).withColumn("_h2", h2)
    d = global_rank(d, ["_h1", key], out="_r1", group=[by])
    n = d.groupBy(by).agg(F.count("*").alias("_n"))
    d = join_same(d, n, [by]).withColumn("_ne", F.ceil(F.col("_n") * test_frac))
    ev = d.where(F.col("_r1") <= F.col("_ne"))
    ev = global_rank(ev, ["_h2", key], out="_r2", group=[by])
    ev = ev.withColumn("part", F.when(F.col("_r2") <= F.ceil(F.col("_ne") / 2.0), F.lit("test"))
                       .otherwise(F.lit("val")))
    tr = d.where(F.col("_r1") > F.col("_ne")).withColumn("_r2", F.lit(None).cast("long")) \
          .withColumn("part", F.lit("train"))
    return ev.unionByName(tr).withColumnRenamed("_r2", "part_rank") \
             .drop("_h1", "_h2", "_r1", "_n", "_ne")


def pooled_test_set(split: DataFrame, key: str = "input", by: str = "dataset",
                    score: str = "redundancy_score", thr: float = 0.9) -> DataFrame:
    """Test parts of all groups pooled: score > thr, and the first
    occurrence of ``key`` in (group order, shuffled order) wins."""
    t = split.where((F.col("part") == "test") & (F.col(score) > thr))
    place = F.struct(F.col(by), F.col("part_rank"))
    first = t.groupBy(F.sha2(F.col(key).cast("string"), 256).alias("_k")).agg(F.min(place).alias("_p")).select(F.col(f"_p.{by}").alias(by), F.col("_p.part_rank").alias("part_rank"))
    return join_same(t, first, [by, "part_rank"], "left_semi")


def cap_dataset(df: DataFrame, key: str, order: str, size: int, max_trials: int | None = None) -> DataFrame:
    """Stop at ``size`` unique keys or after ``max_trials`` rows (default
    5 x size), whichever comes first: a trials cut by rank, first-wins
    dedupe, then an ordered limit (the limit is the feature)."""
    from tracefold.operators.numbering import global_rank
    max_trials = max_trials if max_trials is not None else 5 * size
    r = global_rank(df, [order], out="_trial").where(F.col("_trial") <= max_trials)
    kept = first_per_key(r, key, order)
    kept = global_rank(kept, [order], out="_u").where(F.col("_u") <= size)
    return kept.drop("_trial", "_u")


def pick_uniform(df: DataFrame, key: str, value: str, seed: int = 0) -> DataFrame:
    """One value per key, uniformly by a seeded hash (min_by: partial
    aggregation, hot keys are reduced map-side)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(value).cast("string")))
    return df.groupBy(key).agg(F.min_by(F.col(value), h).alias(value))
