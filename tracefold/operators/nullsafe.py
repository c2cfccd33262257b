"""Joins on keys that may be null.

``on`` joins in Spark drop rows whose key is null on either side; grouping
keeps them.  Operators that group and join back use these joins, so a null
key is a group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join where every key is equal or null on both sides.  The keys come
    from the left, for a full join from whichever side has the row."""
    names = {k: f"_same_{i}" for i, k in enumerate(on)}
    mark = "_same_row"
    r = right.select(*[F.col(f"`{k}`").alias(names[k]) for k in on], *[F.col(f"`{c}`") for c in right.columns if c not in on],
                     *([F.lit(True).alias(mark)] if how == "full" else []))
    if how == "full":
        left = left.withColumn("_same_left", F.lit(True))
    j = left.join(r, reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[names[k]]) for k in on]), how)
    if how in ("left_semi", "left_anti"):
        return j
    if how == "full":
        for k in on:
            j = j.withColumn(k, F.when(F.col("_same_left"), F.col(k)).otherwise(F.col(names[k])))
        j = j.drop("_same_left", mark)
    return j.drop(*names.values())
