"""Queries: write / read round trips of the trace sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators.numbering import prefix_sum
from tracefold.operators.trajectories import episode_lengths
from tracefold.plans import fixtures as V
from tracefold.plans.registry import register
from tracefold.session import scratch_path
from tracefold.sources import traces_io as IO

_TRACE_COLS = "seq, dataset, session, input, exit_code, redundancy_score"


@register("read_traces", V.with_views(f"SELECT {_TRACE_COLS} FROM traces", "traces"))
def q_read_traces(spark, sf):
    t = V.traces(spark, sf)
    root = scratch_path(spark, "traces")
    t.write.partitionBy("dataset").json(root)
    schema = t.drop("dataset").schema
    back = IO.read_traces(spark, root, pattern="*/*.json", schema=schema)
    return back.selectExpr(*_TRACE_COLS.split(", "))


@register("append_traces", V.with_views(f"SELECT {_TRACE_COLS} FROM traces", "traces"))
def q_append_traces(spark, sf):
    t = V.traces(spark, sf)
    root = scratch_path(spark, "append")
    IO.append_traces(t.where(F.col("exit_code") == 0), root)
    IO.append_traces(t.where(F.col("exit_code") != 0), root)
    back = IO.read_traces(spark, root, pattern="*/*.json", schema=t.drop("dataset").schema)
    return back.selectExpr(*_TRACE_COLS.split(", "))


@register("read_episode_log", V.with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, max(episode_id) AS episode, CAST(sum(n) AS BIGINT) AS step
FROM (SELECT episode_id, count(*) AS n FROM steps GROUP BY episode_id)""", "steps"))
def q_episode_log_io(spark, sf):
    e = episode_lengths(V.steps(spark, sf))
    log = prefix_sum(e, ["episode_id"], "n_steps", out="step", inclusive=True) \
        .select(F.col("episode_id").alias("episode"), "step", "n_steps")
    path = scratch_path(spark, "episode_log")
    IO.write_episode_log(log, path)
    back = IO.read_episode_log(spark, path, schema=log.schema)
    r = IO.resume_point(back)
    return r.select(F.col("n_rows").cast("bigint").alias("n_rows"), "episode",
                    F.col("step").cast("bigint").alias("step"))


@register("known_inputs", V.with_views("SELECT DISTINCT input FROM traces", "traces"))
def q_known_inputs(spark, sf):
    t = V.traces(spark, sf)
    path = scratch_path(spark, "registry")
    IO.save_registry(spark, t.where(F.col("exit_code") == 0), path)  # first flush
    IO.save_registry(spark, t, path)                                # second flush adds the rest
    return IO.load_registry(spark, path)
