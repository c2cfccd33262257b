"""Queries: the streaming jobs fed with successive drops of a fixture
table (ordered chunks), one availableNow run per drop, results read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.plans import fixtures as V
from tracefold.plans import q_steps, q_text  # noqa: F401  (batch oracles reused below)
from tracefold.plans.registry import REGISTRY, register
from tracefold.session import scratch_path
from tracefold.sources.tables import table
from tracefold.streaming import jobs as J

N_DROPS = 3


def _drops(df, order: str):
    """Chunk rows into N_DROPS ordered drops by ``order`` (range of the
    order value; only the maximum reaches the driver).  Negative orders come
    with the first drop, null ones with the last."""
    mx = max(df.agg(F.max(order)).first()[0] or 0, 0)
    drop = F.coalesce(F.greatest(F.floor(F.col(order) * N_DROPS / (mx + 1)), F.lit(0)), F.lit(N_DROPS - 1))
    return [df.where(drop == i) for i in range(N_DROPS)]


def _run(spark, df, order, job):
    in_dir = scratch_path(spark, "stream-in")
    for chunk in _drops(df, order):
        chunk.write.mode("append").json(in_dir)
        job(in_dir)


@register("stream_dedupe", V.with_views("SELECT input, min(seq) AS seq FROM traces GROUP BY input", "traces"))
def q_stream_dedupe(spark, sf):
    t = V.traces(spark, sf).select("seq", "input", "exit_code")
    out, ck = scratch_path(spark, "dedupe-out"), scratch_path(spark, "dedupe-ck")
    _run(spark, t, "seq", lambda d: J.stream_dedupe(spark, d, out, ck, t.schema))
    return spark.read.parquet(out).select("input", "seq")


def late_drops(spark, sf):
    """Events in N_DROPS drops, each over all days, so that later drops hold
    many late rows; the event time is the day."""
    e = table(spark, sf, "events").where("ts is not null")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_type", day.alias("day"), F.pmod(F.col("event_id"), F.lit(N_DROPS)).alias("drop"))


@register("stream_dedupe_watermark", f"""
WITH ev AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, event_id % {N_DROPS} AS drop_no FROM events WHERE ts IS NOT NULL),
wm AS (SELECT d.drop_no, max(e.day) - INTERVAL 2 DAY AS wm FROM range(1, {N_DROPS}) d(drop_no) JOIN ev e ON e.drop_no < d.drop_no GROUP BY d.drop_no)
SELECT DISTINCT user_id, event_type, strftime(day, '%Y-%m-%d') AS day FROM ev LEFT JOIN wm USING (drop_no) WHERE wm.wm IS NULL OR ev.day > wm.wm""")
def q_stream_watermark(spark, sf):
    """A user's kinds of events by day, each once, of the rows the watermark
    (two days behind the latest day of earlier drops) admits."""
    e = late_drops(spark, sf)
    in_dir, out, ck = (scratch_path(spark, f"watermark-{x}") for x in ("in", "out", "ck"))
    rows = e.drop("drop")
    for k in range(N_DROPS):
        e.where(F.col("drop") == k).drop("drop").write.mode("append").json(in_dir)
        J.stream_dedupe_watermark(spark, in_dir, out, ck, rows.schema, ["user_id", "event_type", "day"], "day", "2 days")
    return spark.read.schema(rows.schema).parquet(out).select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"))


@register("stream_flush", V.with_views("""
SELECT input, min(seq) AS seq FROM traces t WHERE input NOT IN (
  SELECT t2.input FROM traces t2 JOIN labels l ON t2.seq = l.doc_id WHERE l.quality = 0) GROUP BY input""", "traces"))
def q_stream_flush(spark, sf):
    t = V.traces(spark, sf).select("seq", "input", "exit_code")
    reg = scratch_path(spark, "flush-registry")
    bad = t.join(table(spark, sf, "labels").where(F.col("quality") == 0).select(F.col("doc_id").alias("seq")), "seq")
    bad.select("input").distinct().write.parquet(f"{reg}/flush=seed")  # known before streaming starts
    out, ck = scratch_path(spark, "flush-out"), scratch_path(spark, "flush-ck")
    _run(spark, t, "seq", lambda d: J.stream_flush(spark, d, out, reg, ck, t.schema))
    return spark.read.parquet(out).select("input", "seq")  # all batch=<id> partitions


@register("stream_cwd", REGISTRY["cwd_track"].sql)  # must equal the batch fold
def q_stream_cwd(spark, sf):
    c = V.cmds(spark, sf)
    out, ck = scratch_path(spark, "cwd-out"), scratch_path(spark, "cwd-ck")
    _run(spark, c, "ord", lambda d: J.stream_cwd(spark, d, out, ck, c.schema))
    return spark.read.parquet(out).select("session", "ord", "cmd", "cwd_before", "cwd_after")


@register("stream_history", REGISTRY["bounded_history"].sql)  # must equal the batch op
def q_stream_history(spark, sf):
    r = V.runs(spark, sf).select("k", F.col("run_no").cast("long").alias("run_no"), "exit_code")
    out, ck = scratch_path(spark, "hist-out"), scratch_path(spark, "hist-ck")
    _run(spark, r, "run_no", lambda d: J.stream_history(spark, d, out, ck, r.schema, n=5))
    return J.latest_history(spark, out).select("k", "run_no", "exit_code")
