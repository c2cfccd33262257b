"""Row-level checks and transforms of traces and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.text import WS_CLASS


def clean_exec_result(df: DataFrame, output: str = "output", code: str = "exit_code",
                      max_output: int | None = None) -> DataFrame:
    """Output whole, or cut at max_output chars; 137 (killed) and 124 (timed
    out) count as 0; -1 is a container error."""
    c = F.col(code)
    out = F.col(output) if max_output is None else F.substring(F.col(output), 1, max_output)
    return (df.withColumn(output, out)
              .withColumn("status", F.when(c == -1, F.lit("container_error")).otherwise(F.lit("ok")))
              .withColumn(code, F.when(c.isin(137, 124), F.lit(0)).otherwise(c)))


def validate_actions(df: DataFrame, text: str = "input_addition", exec_flag: str = "exec_action",
                     new_global: str = "new_global", max_arg_len: int = 128) -> DataFrame:
    """-10 and a reason for: exec + new_global; exec with text; text longer
    than max_arg_len.  Checked in that order, first hit wins."""
    ex = F.col(exec_flag) == 1
    reason = (F.when(ex & (F.col(new_global) == 1), F.lit("exec_and_new_global"))
               .when(ex & (F.coalesce(F.length(text), F.lit(0)) > 0), F.lit("exec_with_text"))
               .when(F.coalesce(F.length(text), F.lit(0)) > max_arg_len, F.lit("text_too_long")))
    return df.withColumn("error", reason).withColumn(
        "penalty", F.when(reason.isNotNull(), F.lit(-10.0)).otherwise(F.lit(0.0)))


def training_pairs(df: DataFrame, input_col: str = "input", output: str = "output",
                   context: str = "context_value") -> DataFrame:
    """source = input after its first ';' segment (re-joined by ';');
    target = output + context value."""
    parts = F.split(F.col(input_col), ";")
    src = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ";")
    return df.withColumn("source", src).withColumn(
        "target", F.concat(F.coalesce(F.col(output), F.lit("")), F.coalesce(F.col(context), F.lit(""))))


def select_nonredundant(df: DataFrame, col: str = "redundancy_score", thr: float = 0.9) -> DataFrame:
    return df.where(F.col(col) > thr)


def pad_encode(df: DataFrame, ids: str, size: int, out: str = "enc",
               truncate: int | None = None) -> DataFrame:
    """Adds struct ``out`` = (ids right-padded with 0 to size, length,
    attention mask, labels with pad -> -100).  Longer lists stay whole, or
    are cut to ``truncate`` ids where one is given.  Intermediates are
    projected once, not re-evaluated inside lambdas."""
    cut = F.col(ids) if truncate is None else F.slice(F.col(ids), 1, truncate)
    d = df.withColumn("_cut", cut).withColumn("_n", F.size("_cut"))
    d = d.withColumn("_pad", F.concat("_cut", F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.col("_n"), F.lit(0)))))
    n = F.col("_n")
    enc = F.struct(F.col("_pad").alias("ids"), n.alias("length"),
                   F.transform("_pad", lambda x, i: F.when(i < n, 1).otherwise(0)).alias("mask"),
                   F.transform("_pad", lambda x, i: F.when(i < n, x).otherwise(-100)).alias("labels"))
    return d.withColumn(out, enc).drop("_cut", "_n", "_pad")


def words(col) -> Column:
    """Python ``str.split()``: Unicode whitespace runs, no empty pieces."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, f"{WS_CLASS}+"), lambda x: x != "")


def masked_policy(df: DataFrame, logits: str, mask, action, out: str = "policy",
                  uniform: bool = False) -> DataFrame:
    """Masked-out logits -> -1e5; log-softmax by max-shifted log-sum-exp;
    adds struct ``out`` = (logp of the chosen 0-based action, entropy).
    Uniform policy = all-zero logits."""
    mk = F.col(mask) if isinstance(mask, str) else mask
    a = F.col(action) if isinstance(action, str) else action
    lg = F.transform(logits, lambda x: F.lit(0.0) if uniform else x.cast("double"))
    d = df.withColumn("_z", F.zip_with(lg, mk, lambda x, m: F.when(m == 1, x).otherwise(F.lit(-1e5))))
    d = d.withColumn("_mx", F.array_max("_z"))
    d = d.withColumn("_lse", F.col("_mx") + F.log(F.aggregate("_z", F.lit(0.0),
                                                              lambda acc, x: acc + F.exp(x - F.col("_mx")))))
    d = d.withColumn("_lp", F.transform("_z", lambda x: x - F.col("_lse")))
    ent = -F.aggregate("_lp", F.lit(0.0), lambda acc, lp: acc + F.exp(lp) * lp)
    return d.withColumn(out, F.struct(F.element_at("_lp", a + 1).alias("logp"), ent.alias("entropy"))) \
            .drop("_z", "_mx", "_lse", "_lp")
