"""Indel similarity.  The longest common subsequence is the one place that
needs Python: an Arrow-batched pandas UDF that gets only the rows whose
value is not already decided by a Column expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions.arrays import characters, common_count


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by the bit-parallel row recurrence
    (one big-int per row, bits = positions of the longer string)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


#: Rows of the recurrence between two looks at the bounds.
_LOOK = 64


def lcs_reaches(a: str, b: str, need: int) -> bool:
    """Whether the longest common subsequence has ``need`` characters.  The
    recurrence stops as soon as it has that many, or can't reach them with
    the rows left."""
    if len(a) < len(b):
        a, b = b, a
    if need <= 0 or len(b) < need:
        return need <= 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for row, ch in enumerate(b, 1):
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
        if row % _LOOK == 0 or row == len(b):
            have = len(a) - v.bit_count()
            if have >= need or have + len(b) - row < need:
                return have >= need
    return False


def _reaches_batch(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and lcs_reaches(x, y, int(n)) for x, y, n in zip(a, b, need)], dtype="bool")


def _lcs_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


_UDFS: dict = {}


def _udf(name: str, fn, rtype: str):
    """Build pandas UDFs lazily on the driver (module import in a worker
    must not touch the session)."""
    if name not in _UDFS:
        _UDFS[name] = F.pandas_udf(fn, rtype)
    return _UDFS[name]


def indel_similarity(a, b, max_len: int | None = None) -> Column:
    """2 * LCS / (|a| + |b|) of the whole texts, a null as an empty text; two
    empty texts are alike, an empty and another are not.  ``max_len`` cuts
    both texts first (off by default)."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    if max_len is not None:
        a, b = F.substring(a, 1, max_len), F.substring(b, 1, max_len)
    total = F.length(a) + F.length(b)
    open_ = (a != b) & (F.length(a) > 0) & (F.length(b) > 0)  # only these rows' texts reach Python
    lcs = _udf("lcs", _lcs_batch, "long")(F.when(open_, a), F.when(open_, b))
    return F.when(open_, 2.0 * lcs / total).otherwise((a == b).cast("double"))


def needed_common(total: Column, beta: Column) -> Column:
    """The smallest LCS whose similarity, as a double, is at least beta."""
    enough = lambda n: 2.0 * n / F.greatest(total, F.lit(1)) >= beta
    n = F.ceil(beta * total / 2.0)
    return F.when(enough(n - 1), n - 1).when(enough(n), n).otherwise(n + 1)


def threshold_bounds(a: Column, b: Column, beta: Column) -> Column:
    """Whether the similarity reaches beta, where that needs no subsequence:
    equal or empty texts, lengths too far apart, too few characters in
    common.  Null: open."""
    la, lb = F.length(a), F.length(b)
    need = needed_common(la + lb, beta)
    shared = common_count(F.transform(characters(a), lambda c: F.xxhash64(c)), F.transform(characters(b), lambda c: F.xxhash64(c)))
    return (F.when(a == b, F.lit(1.0) >= beta).when((la == 0) | (lb == 0), F.lit(0.0) >= beta)
             .when(need <= 0, F.lit(True)).when(F.least(la, lb) < need, F.lit(False)).when(shared < need, F.lit(False)))


def similar_at_least(a, b, beta) -> Column:
    """``indel_similarity(a, b) >= beta``: bounds on lengths and character
    counts first, then a recurrence that stops once it is decided."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    beta = F.col(beta) if isinstance(beta, str) else beta
    known = threshold_bounds(a, b, beta)
    open_ = known.isNull() & beta.isNotNull()
    need = needed_common(F.length(a) + F.length(b), beta)
    reached = _udf("reaches", _reaches_batch, "boolean")(F.when(open_, a), F.when(open_, b), F.coalesce(need, F.lit(0)))
    return F.when(beta.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(known, reached))
