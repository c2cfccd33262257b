"""Working-directory tracking over command sessions (recursive blocked scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.paths import FN_TYPE, apply_fn, cd_function, compose, identity_fn
from tracefold.operators.nullsafe import join_same
from tracefold.operators.numbering import global_rank


def _prefix(arr_col: str, fn_field: str):
    """Inclusive prefix compositions of an ordered (block-sized) array."""
    init = F.struct(identity_fn().alias("cur"), F.array().cast(f"array<{FN_TYPE}>").alias("out"))
    return F.aggregate(
        arr_col, init,
        lambda acc, x: F.struct(compose(acc["cur"], x[fn_field]).alias("cur"),
                                F.concat(acc["out"], F.array(compose(acc["cur"], x[fn_field]))).alias("out")))


def prefix_compose(df: DataFrame, group: list, rank: str, fn: str, block: int = 256) -> DataFrame:
    """(group, rank, _incl): composition of all directory functions up to
    and including each row, for a dense 1-based ``rank`` per group.

    Rows are cut into blocks (arrays of at most ``block`` entries are
    folded); the block totals are composed by the same operator applied to
    the block table (``block`` times smaller), so no array grows with the
    group and no group sits in one task."""
    d = df.select(*group, rank, fn).withColumn("_blk", F.floor((F.col(rank) - 1) / block).cast("long"))
    per_blk = d.groupBy(*group, "_blk").agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"),
                                                                             F.col(fn).alias("f")))).alias("_rows"))
    per_blk = per_blk.withColumn("_scan", _prefix("_rows", "f"))
    rows = per_blk.select(*group, "_blk", F.inline(F.arrays_zip(F.col("_rows.r").alias("r"),
                                                                F.col("_scan.out").alias("inc"))))
    rows = rows.select(*group, "_blk", F.col("r").alias(rank), F.col("inc").alias("_in_blk"))
    max_blk = d.agg(F.max("_blk")).first()[0] or 0
    if max_blk > 0:
        tots = per_blk.select(*group, (F.col("_blk") + 1).alias("_br"), F.col("_scan.cur").alias("_tf"))
        up = prefix_compose(tots, group, "_br", "_tf", block)  # composition of blocks 0.._br-1
        incoming = up.select(*group, F.col("_br").alias("_blk"), F.col("_incl").alias("_pre"))
        rows = join_same(rows, incoming, group + ["_blk"], "left")
    else:
        rows = rows.withColumn("_pre", F.lit(None).cast(FN_TYPE))
    pre = F.coalesce(F.col("_pre"), identity_fn())
    return rows.select(*group, rank, compose(pre, F.col("_in_blk")).alias("_incl"))


def cwd_track(cmds: DataFrame, session: str, order: str, cmd: str, start_cwd: str = "/",
              block: int = 256, starts: DataFrame | None = None) -> DataFrame:
    """cwd before and after every command of every session.  ``starts``
    (session, cwd): sessions that begin elsewhere than in ``start_cwd``.

    Commands become directory functions (reset-or-pop-then-append, an
    associative composition); a session is numbered by a range-partitioned
    rank (a hot session is split) and scanned by ``prefix_compose``."""
    d = cmds.withColumn("_f", cd_function(F.col(cmd)))
    d = global_rank(d, [order], out="_rk", group=[session])
    inc = prefix_compose(d, [session], "_rk", "_f", block)
    prev = inc.select(session, (F.col("_rk") + 1).alias("_rk"), F.col("_incl").alias("_excl"))
    r = join_same(join_same(d.select(session, order, cmd, "_rk"), inc, [session, "_rk"]), prev, [session, "_rk"], "left")
    start = F.lit(start_cwd)
    if starts is not None:
        r = join_same(r, starts.select(session, F.col("cwd").alias("_start")), [session], "left")
        start = F.coalesce(F.col("_start"), start)
    return r.select(session, order, cmd,
                    apply_fn(F.coalesce(F.col("_excl"), identity_fn()), start).alias("cwd_before"),
                    apply_fn(F.col("_incl"), start).alias("cwd_after"))
