"""Step-log operators: returns, advantages, reward attribution, update and
snapshot windows, minibatches, standardisation, PPO statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.text import human_format
from tracefold.operators.nullsafe import join_same
from tracefold.operators.numbering import global_rank, grouped_scan, prefix_sum, reverse_discounted_sum


def discounted_return(steps: DataFrame, gamma: float = 0.99, episode: str = "episode_id",
                      t: str = "t", reward: str = "reward", out: str = "G") -> DataFrame:
    """G_t = r_t + gamma * G_{t+1} (two-level block scan, see numbering)."""
    return reverse_discounted_sum(steps, [episode], t, reward, gamma, out=out)


def next_value(steps: DataFrame, episode: str, t: str, value: str, out: str = "v_next") -> DataFrame:
    """V_{t+1} by an equi-join on (episode, t + 1): no per-episode window,
    so a long episode is spread by its (episode, t) keys."""
    nxt = steps.select(F.col(episode), (F.col(t) - 1).alias(t), F.col(value).alias(out))
    return join_same(steps, nxt, [episode, t], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def gae(steps: DataFrame, gamma: float = 0.99, lam: float = 0.95, episode: str = "episode_id",
        t: str = "t", reward: str = "reward", value: str = "value_est",
        out: str = "advantage") -> DataFrame:
    """delta_t = r_t + gamma V_{t+1} - V_t (V past the end 0);
    A_t = delta_t + gamma * lambda * A_{t+1}."""
    s = next_value(steps, episode, t, value)
    s = s.withColumn("delta", F.col(reward) + F.lit(gamma) * F.col("v_next") - F.col(value))
    return reverse_discounted_sum(s, [episode], t, "delta", gamma * lam, out=out)


def attribute_rewards(events: DataFrame, episode: str, seq: str, is_decision: str,
                      reward: str) -> DataFrame:
    """Each environment reward is added to the latest decision at or before
    it in the same episode (as-of by sequence number).  Returns one row
    per decision with its summed reward; a reward with no earlier
    decision is reported with a null decision."""
    # latest decision at or before each row = running max of decision seqs
    # (grouped scan: no per-episode window, a long episode spans partitions)
    e = events.withColumn("_dval", F.when(F.col(is_decision), F.col(seq)))
    e = grouped_scan(e, [episode], [seq], "_dval", op="max", out="_dec") \
        .withColumn("_dec", F.col("_dec").cast(events.schema[seq].dataType))
    decisions = e.where(F.col(is_decision)).select(episode, F.col(seq).alias("decision_seq"))
    got = (e.where(~F.col(is_decision)).groupBy(episode, F.col("_dec").alias("decision_seq"))
            .agg(F.sum(reward).alias("reward"), F.count("*").alias("n_rewards")))
    return join_same(decisions, got, [episode, "decision_seq"], "full") \
                    .withColumn("reward", F.coalesce("reward", F.lit(0.0))) \
                    .withColumn("n_rewards", F.coalesce("n_rewards", F.lit(0)))


def bounded_history(results: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    """Newest n results per key.  A rank filter over a window: Spark plans a
    partial group limit before the shuffle, so a hot key ships <= n rows
    per map task."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_good_attempt(attempts: DataFrame, key: str, attempt: str = "attempt",
                       code: str = "exit_code", max_tries: int = 3,
                       strict_reference: bool = True) -> DataFrame:
    """First attempt (<= max_tries) whose code is not -1.  With
    strict_reference the limit check also fires after a good last try,
    so only attempts < max_tries succeed (status 'limit' otherwise)."""
    ok_limit = max_tries - 1 if strict_reference else max_tries
    a = attempts.where(F.col(attempt) <= max_tries)
    good = F.min(F.when(F.col(code) != -1, F.col(attempt)))
    agg = a.groupBy(key).agg(good.alias("good_attempt"), F.count("*").alias("n_tried"))
    status = (F.when(F.col("good_attempt").isNull(), F.lit("failed"))
               .when(F.col("good_attempt") > ok_limit, F.lit("limit"))
               .otherwise(F.lit("ok")))
    return agg.withColumn("status", status).withColumn(
        "good_attempt", F.when(F.col("status") == "ok", F.col("good_attempt")))


def position_limits(steps: DataFrame, episode: str, t: str, new_cmd: str,
                    local_horizon: int = 13, global_horizon: int = 1) -> DataFrame:
    """Command number (running count of command starts) and argument
    position inside it; truncated when position >= local_horizon + 1 - 4;
    over the command limit when cmd_no > max(1, global) + 1 (the start
    'cd' counts)."""
    s = grouped_scan(steps.withColumn("_nc", F.col(new_cmd).cast("long")), [episode], [t], "_nc",
                     op="sum", out="cmd_no").withColumn("cmd_no", F.col("cmd_no") + 1).drop("_nc")
    # position inside the command: t is dense, so t - first t of the command
    first = s.groupBy(episode, "cmd_no").agg(F.min(t).alias("_t0"))
    s = join_same(s, first, [episode, "cmd_no"]).withColumn("arg_pos", F.col(t) - F.col("_t0")).drop("_t0")
    return (s.withColumn("truncated", F.col("arg_pos") >= local_horizon + 1 - 4)
             .withColumn("over_cmd_limit", F.col("cmd_no") > max(1, global_horizon) + 1))


def episode_lengths(steps: DataFrame, episode: str = "episode_id") -> DataFrame:
    return steps.groupBy(episode).agg(F.count("*").alias("n_steps"))


def update_windows(episodes: DataFrame, order: str, n_steps: str, update_every: int = 1024) -> DataFrame:
    """Update number = floor(steps of all earlier episodes / update_every)
    (the exact form of the reference's threshold counter)."""
    p = prefix_sum(episodes, [order], n_steps, out="steps_before")
    return p.withColumn("update_no", F.floor(F.col("steps_before") / update_every).cast("long"))


def dataset_snapshots(episodes: DataFrame, order: str, every: int = 20000) -> DataFrame:
    """Episodes are cut into snapshots of ``every`` (by arrival rank); the
    snapshot is named by human_format(snapshot_no * every)."""
    r = global_rank(episodes, [order], out="ep_rank")
    snap = F.floor((F.col("ep_rank") - 1) / every).cast("long") + 1
    return r.withColumn("snapshot_no", snap).withColumn("snapshot_name", human_format(snap * every))


def minibatches(df: DataFrame, key: str, batch: int, epochs: int, seed: int = 0) -> DataFrame:
    """Per epoch a seeded shuffle (md5 order) cut into batches of b rows;
    epochs come from a generator, not a join."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    e = e.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"),
                                             F.col(key).cast("string"))))
    r = global_rank(e, ["_h", key], out="_pos", group=["epoch"])
    return r.withColumn("batch_no", F.floor((F.col("_pos") - 1) / batch).cast("long")).drop("_h", "_pos")


def standardize_global(df: DataFrame, col: str, out: str | None = None, eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (population std + eps).  The two statistics are one
    partial-aggregated row; only those two numbers reach the driver."""
    row = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    m, s = (row["m"] or 0.0), (row["s"] or 0.0)
    return df.withColumn(out or f"{col}_std", (F.col(col) - F.lit(m)) / F.lit(s + eps))


def standardize_group(df: DataFrame, col: str, by: list, out: str | None = None) -> DataFrame:
    """Per group (x - mean) / population std; all 0.0 when std is 0.
    Group statistics by a partial aggregate joined back on the key."""
    st = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    j = join_same(df, st, by)
    v = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise((F.col(col) - F.col("_m")) / F.col("_s"))
    return j.withColumn(out or f"{col}_std", v).drop("_m", "_s")


def ppo_diagnostics(df: DataFrame, by: list, new_logp: str = "new_logp", old_logp: str = "old_logp",
                    adv: str = "advantage", ret: str = "G", value: str = "value_est",
                    entropy: str | None = None, eps: float = 0.2, vc: float = 0.5,
                    ec: float = 0.01) -> DataFrame:
    """Policy / value / entropy losses, approximate KL and clip fraction
    per group, from logged columns (no gradients)."""
    ratio = F.exp(F.col(new_logp) - F.col(old_logp))
    surr = F.least(ratio * F.col(adv), F.least(F.greatest(ratio, F.lit(1 - eps)), F.lit(1 + eps)) * F.col(adv))
    ent = F.col(entropy) if entropy else -F.col(new_logp)
    agg = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        (-F.avg(surr)).alias("policy_loss"),
        F.avg(F.pow(F.col(ret) - F.col(value), 2)).alias("value_loss"),
        (-F.lit(ec) * F.avg(ent)).alias("entropy_loss"),
        F.avg(F.col(old_logp) - F.col(new_logp)).alias("approx_kl"),
        F.avg((F.abs(ratio - 1) > eps).cast("double")).alias("clip_frac"))
    return agg.withColumn("total_loss", F.col("policy_loss") + F.lit(vc) * F.col("value_loss")
                          + F.col("entropy_loss"))


def episode_log(steps: DataFrame, episode: str, t: str, cols: list[str], chunk: int = 4096) -> DataFrame:
    """Rows (episode, chunk, n_actions, arrays): an episode's per-step
    columns as ordered arrays of at most ``chunk`` steps each, so no row
    grows with the episode.  ``t`` is the dense step number from 0."""
    s = steps.withColumn("chunk", F.floor(F.col(t) / chunk).cast("long")).groupBy(episode, "chunk").agg(
        F.sort_array(F.collect_list(F.struct(F.col(t), *[F.col(c) for c in cols]))).alias("_st"),
        F.count("*").alias("n_actions"))

    def field(c):
        return F.transform("_st", lambda x: x[c]).alias(c)
    return s.select(episode, "chunk", "n_actions", *[field(c) for c in cols])


def run_summary(df: DataFrame, by: list, episode: str = "episode_id") -> DataFrame:
    per_ep = df.groupBy(*by, episode).agg(F.count("*").alias("_n"))
    return per_ep.groupBy(*by).agg(F.count("*").alias("n_episodes"), F.sum("_n").alias("n_steps"),
                                   F.avg("_n").alias("mean_steps"))


def mean_loss(df: DataFrame, loss: str, by: list) -> DataFrame:
    """Mean of batch losses skipping NaN; denominator max(1, valid)."""
    valid = ~F.isnan(F.col(loss)) & F.col(loss).isNotNull()
    agg = df.groupBy(*by).agg(F.sum(F.when(valid, F.col(loss)).otherwise(0.0)).alias("_s"),
                              F.sum(valid.cast("int")).alias("n_valid"), F.count("*").alias("n_batches"))
    return agg.withColumn("mean_loss", F.col("_s") / F.greatest(F.col("n_valid"), F.lit(1))).drop("_s")
