"""Multiset operations on arrays inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(col: Column) -> Column:
    """A text's code points; a null text has none."""
    return F.when(F.length(col) > 0, F.split(col, "")).otherwise(F.array().cast("array<string>"))


def common_count(left, right) -> Column:
    """Sum over values of the smaller of their two counts, for two arrays of
    64-bit hashes.  Both are sorted into one array with the side as the
    lowest bit; one pass over its runs pairs them off."""
    side = lambda c, bit: F.transform(c, lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(bit)))
    both = F.sort_array(F.concat(side(left, 0), side(right, 1)))  # of one value, the left ones come first
    init = F.struct(F.lit(None).cast("long").alias("value"), F.lit(0).alias("left"), F.lit(0).alias("m"))

    def step(acc, x):
        value, from_right = F.shiftright(x, 1), x.bitwiseAND(F.lit(1)) == 1
        left = F.when(acc["value"] == value, acc["left"]).otherwise(F.lit(0))
        hit = from_right & (left > 0)
        return F.struct(value.alias("value"), F.when(hit, left - 1).when(from_right, left).otherwise(left + 1).alias("left"),
                        F.when(hit, acc["m"] + 1).otherwise(acc["m"]).alias("m"))
    return F.aggregate(both, init, step, lambda acc: acc["m"])
