"""Queries over the step log (events -> steps view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import trajectories as TR
from tracefold.plans import fixtures as V
from tracefold.plans.fmt import r6
from tracefold.plans.registry import register




@register("discounted_return", V.with_views("""
SELECT a.episode_id, a.t, round(sum(b.reward * pow(0.99, b.t - a.t)), 6) AS G
FROM steps a JOIN steps b ON a.episode_id = b.episode_id AND b.t >= a.t
GROUP BY a.episode_id, a.t""", "steps"))
def q_discounted_return(spark, sf):
    g = TR.discounted_return(V.steps(spark, sf), gamma=0.99)
    return g.select("episode_id", "t", r6("G").alias("G"))


@register("discounted_return_undiscounted", V.with_views("""
SELECT a.episode_id, a.t, round(sum(b.reward), 6) AS G
FROM steps a JOIN steps b ON a.episode_id = b.episode_id AND b.t >= a.t
GROUP BY a.episode_id, a.t""", "steps"))
def q_discounted_return_1(spark, sf):
    g = TR.discounted_return(V.steps(spark, sf), gamma=1.0)
    return g.select("episode_id", "t", r6("G").alias("G"))


@register("gae", V.with_views("""
SELECT a.episode_id, a.t, round(sum(b.delta * pow(0.99 * 0.95, b.t - a.t)), 6) AS advantage
FROM d a JOIN d b ON a.episode_id = b.episode_id AND b.t >= a.t
GROUP BY a.episode_id, a.t""", "steps", extra={"d": """
SELECT s.episode_id, s.t, s.reward + 0.99 * coalesce(n.value_est, 0.0) - s.value_est AS delta
FROM steps s LEFT JOIN steps n ON n.episode_id = s.episode_id AND n.t = s.t + 1"""}))
def q_gae(spark, sf):
    g = TR.gae(V.steps(spark, sf), gamma=0.99, lam=0.95)
    return g.select("episode_id", "t", r6("advantage").alias("advantage"))


@register("attribute_rewards", V.with_views("""
SELECT coalesce(d.episode_id, a.episode_id) AS episode_id, coalesce(d.t, a.decision_seq) AS decision_seq,
       round(coalesce(a.reward, 0.0), 6) AS reward, coalesce(a.n_rewards, 0) AS n_rewards
FROM dec d FULL JOIN agg a ON d.episode_id = a.episode_id AND d.t = a.decision_seq""", "steps", extra={
    "dec": "SELECT episode_id, t FROM steps WHERE head <> 'error'",
    "rw": """SELECT s.episode_id, s.reward, (SELECT max(d.t) FROM dec d WHERE d.episode_id = s.episode_id
             AND d.t <= s.t) AS decision_seq FROM steps s WHERE head = 'error'""",
    "agg": """SELECT episode_id, decision_seq, sum(reward) AS reward, CAST(count(*) AS BIGINT) AS n_rewards
              FROM rw GROUP BY episode_id, decision_seq"""}))
def q_attribute_rewards(spark, sf):
    s = V.steps(spark, sf).withColumn("is_decision", F.col("head") != "error")
    a = TR.attribute_rewards(s, "episode_id", "t", "is_decision", "reward")
    return a.select("episode_id", "decision_seq", r6("reward").alias("reward"),
                    F.col("n_rewards").cast("bigint").alias("n_rewards"))


@register("intermediate_reward", V.with_views("""
SELECT episode_id, t, round(delta, 6) AS delta, round(delta / 14.0, 6) AS reward FROM (
  SELECT episode_id, t,
    CASE WHEN exit_code <> 0 THEN 0.0
         WHEN sc - coalesce(lag(sc) OVER (PARTITION BY episode_id ORDER BY t), 0.0) = 0 AND sc = 1.0 THEN 1.0
         ELSE sc - coalesce(lag(sc) OVER (PARTITION BY episode_id ORDER BY t), 0.0) END AS delta
  FROM (SELECT *, CASE WHEN exit_code = 0 THEN greatest(value_est, (event_id % 7) / 6.0) ELSE 0.0 END AS sc
        FROM steps))""", "steps"))
def q_intermediate_reward(spark, sf):
    from tracefold.operators.scoring import intermediate_reward
    s = V.steps(spark, sf).withColumn("ctx", (F.col("event_id") % 7) / F.lit(6.0))
    r = intermediate_reward(s, "episode_id", "t", "value_est", "ctx", local_horizon=13)
    return r.select("episode_id", "t", r6("delta").alias("delta"), r6("reward").alias("reward"))


@register("bounded_history", V.with_views("""
SELECT k, run_no, exit_code FROM runs
QUALIFY row_number() OVER (PARTITION BY k ORDER BY run_no DESC) <= 5""", "runs"))
def q_bounded_history(spark, sf):
    return TR.bounded_history(V.runs(spark, sf), "k", "run_no", n=5).select("k", "run_no", "exit_code")


@register("first_good_attempt", V.with_views("""
SELECT episode_id, CASE WHEN g IS NOT NULL AND g <= 2 THEN g END AS good_attempt, n_tried,
       CASE WHEN g IS NULL THEN 'failed' WHEN g > 2 THEN 'limit' ELSE 'ok' END AS status
FROM (SELECT episode_id, min(CASE WHEN code <> -1 THEN attempt END) AS g, count(*) AS n_tried
      FROM (SELECT episode_id, t + 1 AS attempt, CASE WHEN head = 'error' THEN -1 ELSE 0 END AS code
            FROM steps) WHERE attempt <= 3 GROUP BY episode_id)""", "steps"))
def q_first_good_attempt(spark, sf):
    s = V.steps(spark, sf).select("episode_id", (F.col("t") + 1).alias("attempt"),
                                   F.when(F.col("head") == "error", -1).otherwise(0).alias("code"))
    r = TR.first_good_attempt(s, "episode_id", "attempt", "code", max_tries=3, strict_reference=True)
    return r.select("episode_id", F.col("good_attempt").cast("bigint").alias("good_attempt"),
                    F.col("n_tried").cast("bigint").alias("n_tried"), "status")


@register("position_limits", V.with_views("""
SELECT episode_id, t, cmd_no, arg_pos, arg_pos >= 10 AS truncated, cmd_no > 2 AS over_cmd_limit FROM (
  SELECT episode_id, t, cmd_no, CAST(row_number() OVER (PARTITION BY episode_id, cmd_no ORDER BY t) - 1 AS BIGINT) AS arg_pos
  FROM (SELECT episode_id, t, CAST(sum(CASE WHEN head = 'signup' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS BIGINT) AS cmd_no
        FROM steps))""", "steps"))
def q_position_limits(spark, sf):
    s = V.steps(spark, sf).withColumn("new_cmd", F.col("head") == "signup")
    p = TR.position_limits(s, "episode_id", "t", "new_cmd", local_horizon=13, global_horizon=1)
    return p.select("episode_id", "t", F.col("cmd_no").cast("bigint").alias("cmd_no"),
                    F.col("arg_pos").cast("bigint").alias("arg_pos"), "truncated", "over_cmd_limit")


@register("update_windows", V.with_views("""
SELECT episode_id, n_steps, steps_before, CAST(floor(steps_before / 1024) AS BIGINT) AS update_no FROM (
  SELECT episode_id, n_steps, CAST(coalesce(sum(n_steps) OVER (ORDER BY episode_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS steps_before
  FROM (SELECT episode_id, CAST(count(*) AS BIGINT) AS n_steps FROM steps GROUP BY episode_id))""", "steps"))
def q_update_windows(spark, sf):
    e = TR.episode_lengths(V.steps(spark, sf))
    u = TR.update_windows(e, "episode_id", "n_steps", update_every=1024)
    return u.select("episode_id", F.col("n_steps").cast("bigint").alias("n_steps"),
                    F.col("steps_before").cast("bigint").alias("steps_before"), "update_no")


_HUMAN = """CASE WHEN x >= 1000000000000000 THEN CAST(floor(x / 1000000000000000) AS BIGINT) || 'P'
 WHEN x >= 1000000000000 THEN CAST(floor(x / 1000000000000) AS BIGINT) || 'T'
 WHEN x >= 1000000000 THEN CAST(floor(x / 1000000000) AS BIGINT) || 'G'
 WHEN x >= 1000000 THEN CAST(floor(x / 1000000) AS BIGINT) || 'M'
 WHEN x >= 1000 THEN CAST(floor(x / 1000) AS BIGINT) || 'K'
 WHEN x >= 1 THEN CAST(floor(x) AS BIGINT) || '' END"""


def human_sql(expr: str) -> str:
    return _HUMAN.replace("x", f"({expr})")


@register("dataset_snapshots", V.with_views(f"""
SELECT episode_id, ep_rank, snapshot_no, {human_sql('snapshot_no * 50')} AS snapshot_name FROM (
  SELECT episode_id, ep_rank, CAST(floor((ep_rank - 1) / 50) AS BIGINT) + 1 AS snapshot_no FROM (
    SELECT episode_id, CAST(row_number() OVER (ORDER BY episode_id) AS BIGINT) AS ep_rank
    FROM (SELECT DISTINCT episode_id FROM steps)))""", "steps"))
def q_dataset_snapshots(spark, sf):
    e = V.steps(spark, sf).select("episode_id").distinct()
    d = TR.dataset_snapshots(e, "episode_id", every=50)
    return d.select("episode_id", F.col("ep_rank").cast("bigint").alias("ep_rank"), "snapshot_no",
                    "snapshot_name")


@register("minibatches", V.with_views("""
SELECT event_id, epoch, CAST(floor((row_number() OVER (PARTITION BY epoch ORDER BY
       md5(concat_ws('|', '1', CAST(epoch AS VARCHAR), CAST(event_id AS VARCHAR))), event_id) - 1) / 128) AS BIGINT) AS batch_no
FROM (SELECT event_id, CAST(unnest(range(1, 5)) AS INTEGER) AS epoch FROM steps)""", "steps"))
def q_minibatches(spark, sf):
    s = V.steps(spark, sf).select("event_id")
    m = TR.minibatches(s, "event_id", batch=128, epochs=4, seed=1)
    return m.select("event_id", "epoch", "batch_no")


@register("standardize_global", V.with_views("""
SELECT event_id, round((reward - avg(reward) OVER ()) / (stddev_pop(reward) OVER () + 1e-8), 6) AS reward_std
FROM steps""", "steps"))
def q_standardize_global(spark, sf):
    s = TR.standardize_global(V.steps(spark, sf), "reward", "reward_std")
    return s.select("event_id", r6("reward_std").alias("reward_std"))


@register("standardize_group", V.with_views("""
SELECT event_id, round(CASE WHEN sd = 0 THEN 0.0 ELSE (reward - m) / sd END, 6) AS reward_std FROM (
  SELECT event_id, reward, avg(reward) OVER (PARTITION BY episode_id) AS m,
         stddev_pop(reward) OVER (PARTITION BY episode_id) AS sd FROM steps)""", "steps"))
def q_standardize_group(spark, sf):
    s = TR.standardize_group(V.steps(spark, sf), "reward", ["episode_id"], "reward_std")
    return s.select("event_id", r6("reward_std").alias("reward_std"))


@register("ppo_diagnostics", V.with_views("""
SELECT head, CAST(count(*) AS BIGINT) AS n,
  round(-avg(least(r * adv, least(greatest(r, 0.8), 1.2) * adv)), 6) AS policy_loss,
  round(avg(pow(reward - value_est, 2)), 6) AS value_loss,
  round(-0.01 * avg(-new_logp), 6) AS entropy_loss,
  round(avg(old_logp - new_logp), 6) AS approx_kl,
  round(avg(CASE WHEN abs(r - 1) > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS clip_frac,
  round(-avg(least(r * adv, least(greatest(r, 0.8), 1.2) * adv)) + 0.5 * avg(pow(reward - value_est, 2))
        + -0.01 * avg(-new_logp), 6) AS total_loss
FROM (SELECT *, exp(new_logp - old_logp) AS r, reward - value_est AS adv FROM steps) GROUP BY head""", "steps"))
def q_ppo(spark, sf):
    s = V.steps(spark, sf).withColumn("advantage", F.col("reward") - F.col("value_est")) \
                          .withColumn("G", F.col("reward"))
    p = TR.ppo_diagnostics(s, ["head"])
    return p.select("head", F.col("n").cast("bigint").alias("n"),
                    *[r6(c).alias(c) for c in ["policy_loss", "value_loss", "entropy_loss", "approx_kl",
                                                "clip_frac", "total_loss"]])


@register("episode_log", V.with_views("""
SELECT episode_id, CAST(floor(t / 16) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n_actions,
  string_agg(head, ',' ORDER BY t) AS heads,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t) AS actions,
  round(sum(reward), 6) AS total_reward,
  arg_max(head, t) AS final_head
FROM steps GROUP BY ALL""", "steps"))
def q_episode_log(spark, sf):
    e = TR.episode_log(V.steps(spark, sf), "episode_id", "t", ["head", "event_id", "reward"], chunk=16)
    return e.select("episode_id", "chunk", F.col("n_actions").cast("bigint").alias("n_actions"),
                    F.array_join("head", ",").alias("heads"),
                    F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("actions"),
                    r6(F.aggregate("reward", F.lit(0.0), lambda a, x: a + x)).alias("total_reward"),
                    F.element_at("head", -1).alias("final_head"))


@register("run_summary", V.with_views("""
SELECT head, CAST(count(*) AS BIGINT) AS n_episodes, CAST(sum(n) AS BIGINT) AS n_steps, round(avg(n), 6) AS mean_steps
FROM (SELECT head, episode_id, count(*) AS n FROM steps GROUP BY head, episode_id) GROUP BY head""", "steps"))
def q_run_summary(spark, sf):
    r = TR.run_summary(V.steps(spark, sf), ["head"])
    return r.select("head", F.col("n_episodes").cast("bigint").alias("n_episodes"),
                    F.col("n_steps").cast("bigint").alias("n_steps"), r6("mean_steps").alias("mean_steps"))


@register("mean_loss", V.with_views("""
SELECT head, round(coalesce(sum(CASE WHEN NOT isnan(loss) THEN loss END), 0.0)
                   / greatest(count(CASE WHEN NOT isnan(loss) THEN 1 END), 1), 6) AS mean_loss,
       CAST(count(CASE WHEN NOT isnan(loss) THEN 1 END) AS BIGINT) AS n_valid, CAST(count(*) AS BIGINT) AS n_batches
FROM (SELECT head, CASE WHEN head = 'error' THEN CAST('NaN' AS DOUBLE) ELSE new_logp - old_logp END AS loss FROM steps)
GROUP BY head""", "steps"))
def q_mean_loss(spark, sf):
    s = V.steps(spark, sf).withColumn(
        "loss", F.when(F.col("head") == "error", F.lit(float("nan"))).otherwise(F.col("new_logp") - F.col("old_logp")))
    m = TR.mean_loss(s, "loss", ["head"])
    return m.select("head", r6("mean_loss").alias("mean_loss"), F.col("n_valid").cast("bigint").alias("n_valid"),
                    F.col("n_batches").cast("bigint").alias("n_batches"))
