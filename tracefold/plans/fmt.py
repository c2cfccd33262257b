"""Result rounding that both engines compute bit-identically.

round(x, 9) first absorbs summation-order noise (~1e-16); then
floor(y * 1e6 + 0.5) / 1e6 uses only IEEE operations, so a value that
sits on a 6-place tie rounds the same way in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.round(c, 9) * 1000000.0 + 0.5) / 1000000.0


def sql_r6(text: str) -> str:
    """Rewrite every ``round(expr, 6)`` in oracle SQL to the same form."""
    out, i, key = [], 0, "round("
    while True:
        j = text.find(key, i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        if j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_"):
            out.append(text[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), None
        while depth:
            ch = text[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = text[j + len(key):k - 1]
        if comma is not None and text[comma + 1:k - 1].strip() == "6":
            expr = sql_r6(text[j + len(key):comma])
            out.append(text[i:j] + f"(floor(round(CAST({expr} AS DOUBLE), 9) * 1000000.0 + 0.5) / 1000000.0)")
        else:
            out.append(text[i:j] + key + sql_r6(inner) + ")")
        i = k
