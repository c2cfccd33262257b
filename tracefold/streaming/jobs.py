"""Structured Streaming jobs over continuously arriving trace files.

Each job is an incremental query on a file source with a checkpoint;
``trigger(availableNow=True)`` processes what has arrived and stops, so a
scheduler can run it after every drop and state carries over.

* dedupe / flush: foreachBatch; first occurrence (min order) per key by a
  native aggregate, earlier keys by an anti-join on digests; each batch has
  its own partitions, so a replay rewrites them.
  ``stream_dedupe_watermark``: state that expires with the watermark.
* cwd: foreachBatch over the block scan of cwd_track; the state is a table
  with each session's directory after each batch.
* history: keyed state with the newest N results.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tracefold.operators.nullsafe import join_same
from tracefold.operators.sessions import cwd_track
from tracefold.sources.traces_io import load_registry


def stream_dedupe(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: T.StructType,
                  key: str = "input", order: str = "seq", max_files_per_trigger: int | None = None) -> None:
    """Incremental first-wins dedupe by ``key`` as files arrive.

    A micro-batch is reduced to the first row (min ``order``, null ones last)
    of each of its keys by a native aggregate, and keys of earlier batches go
    by an anti-join on digests: 32 bytes of state a key, no Python call a key.
    State grows with the number of distinct keys (no TTL: a key must stay
    deduplicated forever).  Rows and digests are the batch's own partitions
    (``<out_dir>/batch=<id>``), so a replay rewrites them."""
    state_dir = f"{checkpoint.rstrip('/')}-keys"
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (r.json(in_dir).writeStream.foreachBatch(lambda df, bid: dedupe_batch(df, out_dir, state_dir, bid, key, order))
          .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def digest(key: str) -> Column:
    """A key as 32 bytes (null stays null)."""
    return F.unhex(F.sha2(F.col(key).cast("string"), 256))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least ``order`` (null ones last) of each key, and its
    ``_digest``; a null key is a key."""
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(order).isNull(), F.col(order)))
    return df.groupBy(digest(key).alias("_digest")).agg(best.alias("_row")).select("_digest", "_row.*")


def dedupe_batch(df: DataFrame, out_dir: str, state_dir: str, batch_id: int, key: str, order: str) -> None:
    """One micro-batch: its keys' first rows, without the keys of earlier batches."""
    spark, out = df.sparkSession, f"{out_dir.rstrip('/')}/batch={batch_id}"
    new = first_rows(df, key, order)
    if batch_id:
        before = spark.read.schema("_digest binary, batch long").parquet(state_dir).where(F.col("batch") < batch_id)
        new = join_same(new, before, ["_digest"], "left_anti")
    new.drop("_digest").write.mode("overwrite").parquet(out)
    done = spark.read.schema(df.schema).parquet(out)
    done.select(digest(key).alias("_digest")).write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")


def _first_unseen_fn(order: str, cols: list[str]):
    """The same for applyInPandasWithState: one call a key."""
    def first_unseen(k, pdfs, state):
        best = None  # running minimum: one row is held, however many the batch has
        for pdf in pdfs:
            if state.exists or pdf.empty:  # an emitted key is only drained
                continue
            row = pdf.sort_values(order, kind="stable", na_position="last").head(1)[cols]  # null orders come last
            new, old = row[order].iloc[0], None if best is None else best[order].iloc[0]
            if best is None or (not pd.isna(new) and (pd.isna(old) or new < old)):
                best = row
        if best is not None:
            state.update((True,))
            yield best
    return first_unseen


def stream_dedupe_watermark(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: T.StructType,
                            key: list[str], event_time: str, delay: str, max_files_per_trigger: int | None = None) -> int:
    """Dedupe by ``key`` with state that expires: a key is held until the
    watermark (the latest event time of earlier batches less ``delay``) has
    passed its own event time by ``delay``; rows not later than the watermark
    are late and dropped.  So duplicates less than ``delay`` apart give one row
    and the state holds the keys of about two delays, not of all time.  Of
    equal keys in one batch any row is kept.  Returns the number of keys in
    the state after the run."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    fresh = r.json(in_dir).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    q = (fresh.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
              .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    last = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return int(last[-1]) if last else 0


def run_tag(checkpoint: str) -> str:
    """Short name of one streaming query, the same after every restart."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:10]


def flush_write(df: DataFrame, out_dir: str, registry: str, name: str, key: str = "input") -> None:
    """Write one flush: the traces and their keys, each into the partition
    of that name, overwritten as a whole, so replaying a batch rewrites the
    same files instead of appending twice."""
    out = f"{out_dir.rstrip('/')}/batch={name}"
    df.write.mode("overwrite").parquet(out)
    done = df.sparkSession.read.schema(df.schema).parquet(out)
    done.select(key).write.mode("overwrite").parquet(f"{registry.rstrip('/')}/flush={name}")


def registered_before(spark: SparkSession, registry: str, tag: str, batch_id: int, key: str = "input") -> DataFrame:
    """Keys in the registry without those of batch ``batch_id`` of the streaming
    query ``tag`` or its later ones.  A replayed batch must not meet its own
    keys here: it would be emptied and then overwritten with nothing."""
    known = load_registry(spark, registry, [key, "flush"])
    name = F.col("flush").cast("string")
    number = F.when(name.startswith(tag + "-"), F.substring_index(name, "-", -1).cast("long"))
    return known.where(number.isNull() | (number < batch_id)).select(key)


def stream_flush(spark: SparkSession, in_dir: str, out_dir: str, registry: str, checkpoint: str,
                 schema: T.StructType, key: str = "input", order: str = "seq",
                 max_files_per_trigger: int | None = None) -> None:
    """Every micro-batch (bounded by maxFilesPerTrigger, the flush size):
    its keys' first rows, less those registered by anyone else or by an
    earlier batch (an anti-join on digests), are flushed together with
    their registry keys (``flush_write``), so the registry is the state.
    Registry layout: ``<registry>/flush=<name>/`` partitions, named by query
    and batch (read with load_registry)."""
    tag = run_tag(checkpoint)
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)

    def flush(df: DataFrame, batch_id: int) -> None:
        known = registered_before(spark, registry, tag, batch_id, key).select(digest(key).alias("_digest"))
        fresh = join_same(first_rows(df, key, order), known, ["_digest"], "left_anti").drop("_digest")
        flush_write(fresh, out_dir, registry, f"{tag}-{batch_id}", key)

    q = (r.json(in_dir).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


#: Every so many batches the directories of all sessions are written, else of those a batch touched.
COMPACT_EVERY = 20


def cwd_batch(df: DataFrame, out_dir: str, state_dir: str, batch_id: int, session: str, order: str, cmd: str,
              start_cwd: str = "/", compact_every: int = COMPACT_EVERY) -> None:
    """One micro-batch of commands: directories start where the latest
    earlier batch left each session.  The directory functions are composed
    by the block scan of ``cwd_track``, so no session sits in one task; the
    state is one (session, cwd) row for each session a batch touched, and at
    every ``compact_every``-th batch one for each session so far, so a batch
    reads the last full state and what came after it.  Both outputs are the
    batch's own partitions: a replay rewrites them."""
    spark = df.sparkSession
    state = T.StructType([df.schema[session], T.StructField("cwd", T.StringType()), T.StructField("batch", T.LongType())])
    full = max(batch_id - 1, 0) // compact_every * compact_every  # the last full state before this batch
    try:
        before = spark.read.schema(state).parquet(state_dir).where((F.col("batch") < batch_id) & (F.col("batch") >= full))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = spark.createDataFrame([], state)
    starts = before.groupBy(session).agg(F.max_by("cwd", "batch").alias("cwd"))
    done = cwd_track(df, session, order, cmd, start_cwd, starts=starts)
    done.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")
    done = spark.read.parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")
    last = done.groupBy(session).agg(F.max_by("cwd_after", order).alias("cwd"))
    if batch_id and batch_id % compact_every == 0:
        last = last.unionByName(join_same(starts, last, [session], "left_anti"))
    last.write.mode("overwrite").parquet(f"{state_dir.rstrip('/')}/batch={batch_id}")


def stream_cwd(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: T.StructType,
               session: str = "session", order: str = "ord", cmd: str = "cmd", start_cwd: str = "/") -> None:
    """Working directory per session, carried across micro-batches."""
    s = spark.readStream.schema(schema).json(in_dir)
    state_dir = f"{checkpoint.rstrip('/')}-cwd"
    q = (s.writeStream.foreachBatch(lambda df, bid: cwd_batch(df, out_dir, state_dir, bid, session, order, cmd, start_cwd))
          .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


HIST_OUT = "k string, run_no long, exit_code int, version long"


def stream_history(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: T.StructType,
                   n: int = 5, key: str = "k", order: str = "run_no") -> None:
    """Newest n results per key as state; every update emits the key's
    current list with a version number (readers keep the latest)."""
    def keep(k, pdfs, state):
        if state.exists:
            old, version = json.loads(state.get[0]), state.get[1]
        else:
            old, version = [], 0
        rows = old
        for p in pdfs:  # never more than the newest n and one Arrow batch
            new = p.nlargest(n, order)[[order, "exit_code"]].itertuples(index=False)
            rows = heapq.nlargest(n, rows + [[int(r[0]), int(r[1])] for r in new], key=lambda x: x[0])
        version += 1
        state.update((json.dumps(rows), version))
        yield pd.DataFrame({"k": [k[0]] * len(rows), "run_no": [r[0] for r in rows],
                            "exit_code": [r[1] for r in rows], "version": [version] * len(rows)})

    s = spark.readStream.schema(schema).json(in_dir)
    out = s.groupBy(key).applyInPandasWithState(keep, HIST_OUT, "rows string, version long", "append",
                                                GroupStateTimeout.NoTimeout)
    q = (out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def latest_history(spark: SparkSession, out_dir: str) -> DataFrame:
    h = spark.read.parquet(out_dir)
    last = h.groupBy("k").agg(F.max("version").alias("version"))
    return h.join(last, ["k", "version"]).drop("version")
