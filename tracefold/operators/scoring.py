"""Trace scores and rewards (final-only and stepwise modes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.nullsafe import join_same


def score_traces(df: DataFrame, out_col: str = "output_redundancy_score",
                 ctx_col: str = "context_redundancy_score", code_col: str = "exit_code",
                 args_col: str = "n_args", margin: float = 0.5, local_horizon: int = 13,
                 mode: str = "final") -> DataFrame:
    """ok (code 0): score = max(out, ctx), exit_score 1, penalty 0;
    error: out = ctx = score = 0, exit_score -1, penalty -1, key 'none'.
    reward = args / (local_horizon + 1) * (score - margin) + penalty.
    A bare command (no args) scores 0.5/0.5 in final mode, 0/0 stepwise."""
    ok = F.col(code_col) == 0
    bare = F.lit(0.5 if mode == "final" else 0.0)
    out = F.when(F.col(args_col) == 0, bare).otherwise(F.col(out_col))
    ctx = F.when(F.col(args_col) == 0, bare).otherwise(F.col(ctx_col))
    out = F.when(ok, out).otherwise(F.lit(0.0))
    ctx = F.when(ok, ctx).otherwise(F.lit(0.0))
    res = (df.withColumn(out_col, out).withColumn(ctx_col, ctx)
             .withColumn("redundancy_score", F.greatest(F.col(out_col), F.col(ctx_col)))
             .withColumn("exit_score", F.when(ok, F.lit(1.0)).otherwise(F.lit(-1.0)))
             .withColumn("exit_penalty", F.when(ok, F.lit(0.0)).otherwise(F.lit(-1.0))))
    if "context_key" in df.columns:
        res = res.withColumn("context_key", F.when(ok, F.col("context_key")).otherwise(F.lit("none")))
    mass = F.col(args_col) / F.lit(float(local_horizon + 1))
    return res.withColumn("reward", mass * (F.col("redundancy_score") - F.lit(margin))
                          + F.col("exit_penalty"))


def intermediate_reward(steps: DataFrame, key: str, pos: str, out_col: str, ctx_col: str,
                        code_col: str = "exit_code", local_horizon: int = 13) -> DataFrame:
    """Per added argument: score = max(out, ctx); an error gives delta 0
    and remembers 0; else delta = score - previous remembered score (0
    before the first), but 1.0 when delta is 0 and score is 1.
    reward = delta / (local_horizon + 1)."""
    ok = F.col(code_col) == 0
    remembered = F.when(ok, F.greatest(F.col(out_col), F.col(ctx_col))).otherwise(F.lit(0.0))
    s = steps.withColumn("step_score", remembered)
    # previous position's score by an equi-join on (key, pos + 1): positions
    # are dense, and no per-key window holds a whole trace in one task
    prv = s.select(key, (F.col(pos) + 1).alias(pos), F.col("step_score").alias("_prev"))
    s = join_same(s, prv, [key, pos], "left")
    prev = F.coalesce(F.col("_prev"), F.lit(0.0))
    delta = F.col("step_score") - prev
    delta = F.when(~ok, F.lit(0.0)).when((delta == 0) & (F.col("step_score") == 1.0), F.lit(1.0)) \
             .otherwise(delta)
    return s.withColumn("delta", delta).withColumn("reward", F.col("delta") / F.lit(float(local_horizon + 1))) \
            .drop("_prev")
