"""Trace datasets, episode logs and the known-input registry.

Layouts follow the reference: ``<root>/<dataset>/<file>.ndjson`` (the
directory names the dataset), an episode log file, and a registry of
already written inputs.  Writes go to the shared storage the caller
names (on a cluster: under spark.checkpoint.dir), never a local temp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.nullsafe import join_same

TRACE = T.StructType([
    T.StructField("input", T.StringType()), T.StructField("output", T.StringType()),
    T.StructField("output_len", T.IntegerType()), T.StructField("exit_code", T.IntegerType()),
    T.StructField("exit_score", T.DoubleType()), T.StructField("redundancy_score", T.DoubleType()),
    T.StructField("output_redundancy_score", T.DoubleType()),
    T.StructField("context_redundancy_score", T.DoubleType()),
    T.StructField("context_key", T.StringType()), T.StructField("context_value", T.StringType()),
    T.StructField("exec_time", T.DoubleType()), T.StructField("cwd", T.StringType()),
    T.StructField("image", T.StringType()), T.StructField("session_id", T.LongType()),
])


def read_traces(spark: SparkSession, root: str, pattern: str,
                schema: T.StructType = TRACE) -> DataFrame:
    """Every dataset directory under root; ``dataset`` = directory name
    (a ``key=`` partition prefix is dropped)."""
    df = spark.read.schema(schema).json(f"{root.rstrip('/')}/{pattern}")
    d = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return df.withColumn("dataset", F.regexp_replace(d, r"^[^=]*=", ""))


def append_traces(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (one directory per dataset when the frame
    has a ``dataset`` column)."""
    w = df.write.mode("append")
    if "dataset" in df.columns:
        w = w.partitionBy("dataset")
    w.json(path)


def write_episode_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_episode_log(spark: SparkSession, path: str, multi_line: bool = False,
                     schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, or the reference's single indented JSON array when
    ``multi_line``.  A missing log reads as empty."""
    from pyspark.errors import AnalysisException
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    try:
        return r.json(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resume_point(log: DataFrame, episode: str = "episode", step: str = "step") -> DataFrame:
    """(episode, step) of the last logged row; zeros when the log is empty."""
    last = log.agg(F.max_by(F.struct(F.col(episode).alias("episode"), F.col(step).alias("step")),
                            F.col(episode)).alias("r"), F.count("*").alias("n_rows"))
    return last.select("n_rows", F.coalesce("r.episode", F.lit(0)).alias("episode"),
                       F.coalesce("r.step", F.lit(0)).alias("step"))


def load_registry(spark: SparkSession, path: str, key: str | list[str] = "input") -> DataFrame:
    """Registered keys; a registry that was never written is empty.  Any
    other fault (a wrong schema, an unreadable file) is raised."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        keys = [key] if isinstance(key, str) else key
        return spark.createDataFrame([], T.StructType([T.StructField(k, T.StringType()) for k in keys]))


def save_registry(spark: SparkSession, new: DataFrame, path: str, key: str = "input") -> int:
    """Append only keys not yet registered (null is a key like any other);
    returns how many were added."""
    known = load_registry(spark, path, key)
    fresh = join_same(new.select(key).distinct(), known, [key], "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
