"""Centroid clustering of integer vectors: exact k-means rounds by Shallot search.

A vector keeps, from round to round, its nearest and second-nearest centroid,
an upper bound on the distance to the one and a lower bound on the distance
to all others; the centroids' moves widen the bounds.  A vector whose bounds
still tell the two apart is skipped.  For the others

* the remembered two are measured first and the scan starts at the closer;
* its fellow centroids are tried in order of their distance to it, until
  that distance exceeds the start's distance plus the second-best distance
  found so far: the ball shrinks while the scan goes on;
* survivors are measured and compared in integers, ties to the smaller
  number, so the result is that of a full scan.

Bounds are doubles widened by a relative margin; they only ever decide that
something is strictly farther.

On Spark: the vectors with their bounds are one table, written once a round
(a lost executor costs a task); no vector is shuffled.  A round's sums are
partial rows per task (a row per centroid), added up by a grouped sum; the
driver holds the centroids only (k x dim).

Defined results: rows whose vector is null, has another number of
components, or a null or non-finite one take no part; nor do vectors with a
component beyond +-2**21, as their squared distances fit no long.  Repeated
rows are vectors of their own; a null id hashes as the empty text; equal
hashes are ordered by their vectors.  Fewer vectors than k: that many
centroids.  An inertia beyond a long is null.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import stored

K, ROUNDS, SCALE, DIM = 16, 3, 64, 64
#: |floor(64 x)| stays within 2**27, so 64 squared differences fit a long.
_LARGEST = float(1 << 21)
_FAR, _NEAR = 1 + 1e-9, 1 - 1e-9


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>): the rows that take part, as integers."""
    x = F.col("_x")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= _LARGEST * SCALE / scale))
    out = vectors.select(vectors[key].alias("vec_id"), vectors[vector].cast("array<double>").alias("_x"))
    out = out.where(x.isNotNull() & (F.size(x) == dim)).where(fine)
    return out.select("vec_id", F.transform(x, lambda e: F.floor(e * float(scale)).cast("int")).alias("v"))


def start(kept: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<vec_id>``."""
    tag = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(tag.alias("tag"), "v").orderBy("tag", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Per vector: nearest and second-nearest centroid, upper and lower bound."""

    def __init__(self, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.first, self.second, self.upper, self.lower = first, second, upper, lower

    @classmethod
    def unknown(cls, n: int) -> "Bounds":
        return cls(np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n))

    def moved(self, drift: np.ndarray) -> None:
        """Widen by the distances the centroids moved."""
        most = np.array([np.delete(drift, c).max(initial=0.0) for c in range(len(drift))])
        self.upper = (self.upper + drift[self.first]) * _FAR
        self.lower = np.maximum((self.lower - most[self.first]) * _NEAR, 0.0)


def neighbours(cent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of each centroid's fellows, nearest first."""
    k = len(cent)
    d = np.stack([np.sqrt(squared(cent, cent[i][None, :]).astype(np.float64)) for i in range(k)])
    d[np.arange(k), np.arange(k)] = -1.0
    order = np.argsort(d, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(d, order, 1)


def assign(v: np.ndarray, cent: np.ndarray, b: Bounds) -> int:
    """Bring the bounds up to date; returns the number of distances measured."""
    n = len(v)
    if len(cent) == 1:
        b.first[:], b.second[:] = 0, 0
        b.upper, b.lower = np.full(n, np.inf), np.zeros(n)
        return 0
    order, dist = neighbours(cent)
    half = dist[:, 0] / 2
    apart = lambda i: b.upper[i] * _FAR < np.maximum(b.lower[i], half[b.first[i]]) * _NEAR
    at = np.flatnonzero(~apart(slice(None)))
    d1 = squared(v[at], cent[b.first[at]])
    work = len(at)
    b.upper[at] = np.sqrt(d1.astype(np.float64))
    open_ = ~apart(at)
    at, d1 = at[open_], d1[open_]
    if not len(at):
        return work
    x, c1, c2 = v[at], b.first[at], b.second[at]
    d2 = squared(x, cent[c2])
    work += len(at)
    swap = (d2 < d1) | ((d2 == d1) & (c2 < c1))
    c1, c2, d1, d2 = np.where(swap, c2, c1), np.where(swap, c1, c2), np.where(swap, d2, d1), np.where(swap, d1, d2)
    centre, other, radius = c1.copy(), c2.copy(), np.sqrt(d1.astype(np.float64))
    live = np.arange(len(at))
    for j in range(order.shape[1]):
        ball = (radius[live] + np.sqrt(d2[live].astype(np.float64))) * _FAR
        live = live[dist[centre[live], j] * _NEAR <= ball]
        if not len(live):
            break
        cand = order[centre[live], j]
        new = cand != other[live]
        who, cand = live[new], cand[new]
        d = squared(x[who], cent[cand])
        work += len(who)
        best = (d < d1[who]) | ((d == d1[who]) & (cand < c1[who]))
        next_ = ~best & ((d < d2[who]) | ((d == d2[who]) & (cand < c2[who])))
        w = who[best]
        c2[w], d2[w] = c1[w], d1[w]
        c1[w], d1[w] = cand[best], d[best]
        w = who[next_]
        c2[w], d2[w] = cand[next_], d[next_]
    b.first[at], b.second[at] = c1, c2
    b.upper[at], b.lower[at] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
    return work


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _round(table: DataFrame, cent: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """Every vector assigned: (vec_id, v, first, second, upper, lower, distance)."""
    dim = cent.shape[1]

    def run(batches):
        for t in batches:
            v = _matrix(t.column("v"), dim)
            if drift is None:
                b = Bounds.unknown(len(v))
            else:
                get = lambda c: t.column(c).to_numpy(zero_copy_only=False)
                b = Bounds(get("first").astype(np.int64), get("second").astype(np.int64), get("upper").copy(), get("lower").copy())
                b.moved(drift)
            assign(v, cent, b)
            own = squared(v, cent[b.first])
            yield pa.RecordBatch.from_arrays([t.column("vec_id"), t.column("v"), pa.array(b.first, pa.int32()), pa.array(b.second, pa.int32()),
                                              pa.array(b.upper), pa.array(b.lower), pa.array(own)],
                                             ["vec_id", "v", "first", "second", "upper", "lower", "distance"])

    key = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {key}, v array<int>, first int, second int, upper double, lower double, distance long")


def _means(assigned: DataFrame, cent: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's exact mean; empty clusters stay."""
    k, dim = cent.shape

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for t in batches:
            c = t.column("first").to_numpy()
            order = np.argsort(c, kind="stable")
            v, c = _matrix(t.column("v"), dim)[order], c[order]
            here, first = np.unique(c, return_index=True)
            total[here] += np.add.reduceat(v, first, axis=0)
            n += np.bincount(c, minlength=k)
        some = np.flatnonzero(n)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), rows], ["c", "n", "total"])

    parts = assigned.select("first", "v").mapInArrow(run, "c int, n long, total array<long>")
    sums = (parts.select("c", "n", F.posexplode("total").alias("at", "x")).groupBy("c", "at")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect())  # k x dim rows
    out = cent.copy()
    for r in sums:
        out[r["c"], r["at"]] = int(r["x"]) // r["n"]
    return out


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(final centroids, every vector of ``kept`` assigned to them)."""
    cent = start(kept, k)
    if not len(cent):
        return cent, kept.select("vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("first", "int"), ("second", "int"), ("upper", "double"), ("lower", "double"), ("distance", "long"))])
    table, drift = kept, None
    for r in range(rounds):
        table = stored(_round(table, cent, drift), f"kmeans-{r}")
        new = _means(table, cent)
        drift, cent = np.sqrt(squared(new, cent).astype(np.float64)) * _FAR, new
    return cent, stored(_round(table, cent, drift), "kmeans-last")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    cent, assigned = fit(usable(vectors), k, rounds)
    per = {r["first"]: r["s"] for r in assigned.groupBy("first").agg(F.expr("try_sum(distance)").alias("s")).collect()}  # k rows
    fits = lambda x: x if x is None or x < 1 << 63 else None
    total = None if None in per.values() else fits(sum(per.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent.tolist()]
    pick = lambda xs, t: F.element_at(F.array(*[F.lit(x).cast(t) for x in xs]), F.col("first") + 1) if xs else F.lit(None).cast(t)
    return assigned.select("vec_id", F.col("first").alias("cluster"), "distance", pick([per.get(c) for c in range(len(cent))], "long").alias("cluster_inertia"),
                           F.lit(total).cast("long").alias("inertia"), pick(names, "string").alias("centroid_sha256"))


def oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``cluster``: every vector against every centroid."""
    assign_ = lambda r: (
        f"a{r} AS (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.id, m.c, CAST(list_sum(list_transform(list_zip(k.v, m.v), "
        f"lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k, c{r} m) GROUP BY id)")
    move = lambda r: (
        f"s{r} AS (SELECT a.c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{r} a JOIN kept k USING (id), range(1, {DIM + 1}) t(i) GROUP BY a.c, i), "
        f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c), "
        f"c{r + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    steps = ", ".join(f"{assign_(r)}, {move(r)}" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) <= {int(_LARGEST)})) = {DIM}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v
       FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{steps}, {assign_(rounds)},
per AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY c)
SELECT k.vec_id, a.c AS cluster, a.d AS distance, p.s AS cluster_inertia, CAST((SELECT sum(s) FROM per) AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (id) JOIN per p ON p.c = a.c JOIN c{rounds} m ON m.c = a.c"""
