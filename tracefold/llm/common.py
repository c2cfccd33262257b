"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.session import stored  # noqa: F401

#: A table is broadcast only when it has at most this many narrow rows (about 32 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count (of a stored table: from its file
    footers); larger tables are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def crc_remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(mod)
