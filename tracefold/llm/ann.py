"""Approximate nearest neighbours: one hierarchical navigable small-world
graph per shard, shard results merged.

Rows are dealt into shards by a hash of id and vector, one task a shard: as
many as the session has cores while a shard holds SHARD_LEAST to SHARD_ROWS of
them, more beyond; SHARD_ROWS and SHARD_BYTES of float components bound what a
Python worker holds.  Shards are few, as every query meets every shard.  In a
shard every distinct vector is a node with a random top level; a level's graph is an array of neighbours (row = node of that level,
-1 = none).  A node's links on a level are picked from its nearest nodes of
that level by the diversity rule (a candidate is linked unless a node linked
before is nearer to it than the node itself), then the reverse links are added
and both are thinned by the same rule.  The index table in the shared folder
has a row for each row of the shard; the first of a node has its vector and
links.  No row of any table grows with the input.

A search descends from the entry node level by level and ends with a beam of
EF nodes on level 0, for all queries of a block at once in numpy.  A shard's
task gets its index rows once, then its queries batch by batch.  The beam's
nodes are scored again in double precision on the original vectors; ids of
equal vectors come together, smaller first.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, neither as query nor as candidate; a query meets
only vectors of its own length; equal rows count once; rows of one id with
other vectors are all searched and all search, and a pair of ids has the best
score of their rows; a query's own id is no candidate; fewer than k candidates
give fewer rows; an empty table gives none.  Where one id or one vector fills
a beam, the beam is widened until k other ids are found or the shard ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import stored

SHARD_LEAST, SHARD_ROWS, SHARD_BYTES, QUERY_ROWS = 4096, 65536, 32 << 20, 512
LINKS, NEAREST, EF = 16, 48, 80
#: Nodes that a step of the beam looks behind; rows and columns of a block of similarities; bytes of a search's largest arrays.
STEP, BLOCK, TILE, HELD = 4, 256, 8192, 8 << 20


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim): the distinct valid rows; floats stay floats,
    other components become doubles."""
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    v = vectors.select(vectors[key].alias("vec_id"), vectors[vector].cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(fine & F.exists("embedding", lambda x: x != 0))
    v = v.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)).alias("embedding"))  # -0.0 is 0.0
    return v.distinct().withColumn("dim", F.size("embedding"))


def _closest(x: np.ndarray, at: int, end: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``near`` other rows most similar to rows at:end, by falling
    similarity, and these.  Columns come in tiles; from the first on only what
    beats the last of those found is looked at."""
    m, n = end - at, len(x)
    best, sim = np.full((m, near), -1, np.int32), np.full((m, near), -np.inf, np.float32)
    least = np.full((m, 1), -np.inf, np.float32)
    sims, hits = np.empty(m * TILE, np.float32), np.empty(m * TILE, bool)
    for b in range(0, n, TILE):
        w = min(TILE, n - b)
        s = np.matmul(x[at:end], x[b: b + w].T, out=sims[: m * w].reshape(m, w))
        own = np.arange(max(at, b), min(end, b + w))
        s[own - at, own - b] = -np.inf
        if not b and (groups := w // 8) > near:  # maxima of groups of 8 bound the last from below
            tops = s[:, : groups * 8].reshape(m, 8, groups).max(1)
            least = np.partition(tops, groups - near, axis=1)[:, groups - near, None]
        (np.greater if b else np.greater_equal)(s, least, out=hits[: m * w].reshape(m, w))
        hits[m * w: -(-m * w // 8) * 8] = False
        eight = np.flatnonzero(hits[: -(-m * w // 8) * 8].view(np.uint64))  # most have none
        inside = np.flatnonzero(hits.reshape(-1, 8).take(eight, axis=0))
        found = eight.take(inside // 8) * 8 + inside % 8
        if not len(found):
            continue
        row = found // w
        count = np.bincount(row, minlength=m)
        wide = near + int(count.max())
        place = np.arange(len(row)) - (np.cumsum(count) - count).take(row) + row * wide + near
        more, more_sim = np.full((m, wide), -1, np.int32), np.full((m, wide), np.inf, np.float32)
        more[:, :near], more_sim[:, :near] = best, -sim
        more.reshape(-1)[place], more_sim.reshape(-1)[place] = found - row * w + b, -s.reshape(-1).take(found)
        top = np.argpartition(more_sim, near - 1, axis=1)[:, :near] + np.arange(m)[:, None] * wide
        best, sim = more.take(top), -more_sim.take(top)
        least = sim.min(1, keepdims=True)
    rank = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(best, rank, 1), np.take_along_axis(sim, rank, 1)


def _diverse(own: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's nodes, sorted by falling similarity (-1: none, last),
    the diversity rule links."""
    kept, near, count = np.zeros(own.shape, bool), np.full(own.shape, -np.inf, np.float32), np.zeros(len(own), np.int64)
    wide = own.shape[1] > 4 * NEAREST
    v = x[own]
    among = None if wide else np.matmul(v, v.transpose(0, 2, 1))
    for c in range(own.shape[1]):
        rows = np.flatnonzero((near[:, c] < sims[:, c]) & (count < most) & (own[:, c] >= 0))
        if len(rows):
            kept[rows, c] = True
            count[rows] += 1
            near[rows] = np.maximum(near[rows], np.matmul(v[rows], v[rows, c][:, :, None])[..., 0] if wide else among[rows, c])
        elif wide and (count >= most).all():
            break
    return kept


def _join(x: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Links of each node from its forward links and those to it: all, or
    2*LINKS picked by the diversity rule, filled up with the nearest."""
    n = len(x)
    i, j = np.repeat(np.arange(n), (forward >= 0).sum(1)), forward[forward >= 0].astype(np.int64)
    pair = np.sort(np.concatenate([i * n + j, j * n + i]))
    pair = pair[np.diff(pair, prepend=-1) > 0]
    a, b = pair // n, (pair % n).astype(np.int32)
    s = np.concatenate([np.einsum("ij,ij->i", x[a[k: k + TILE]], x[b[k: k + TILE]]) for k in range(0, len(a), TILE)] or [np.zeros(0, np.float32)])
    rank = np.lexsort((-s, a))
    b, s = b[rank], s[rank]
    count = np.bincount(a, minlength=n)
    first = np.cumsum(count) - count
    links = np.full((n, 2 * LINKS), -1, np.int32)
    place = np.arange(len(a)) - first[a]
    few = count[a] <= 2 * LINKS
    links[a[few], place[few]] = b[few]
    many = np.flatnonzero(count > 2 * LINKS)
    many = many[np.argsort(count[many], kind="stable")]
    at = 0
    while at < len(many):
        rows = max(1, min(BLOCK, HELD // 4 // (4 * int(count[many[at]]) * (min(int(count[many[at]]), 4 * NEAREST) + x.shape[1]))))
        some = many[at: at + rows]
        some = some[count[some] <= max(2 * int(count[some[0]]), 64)]
        at += len(some)
        place = np.arange(count[some[-1]])
        there = place < count[some][:, None]
        where = np.where(there, first[some][:, None] + place, 0)
        own, sims = np.where(there, b[where], -1), np.where(there, s[where], -np.inf)
        kind = np.where(_diverse(own, sims, x, 2 * LINKS), 0, np.where(there, 1, 2))
        links[some] = np.take_along_axis(own, np.argsort(kind, axis=1, kind="stable")[:, : 2 * LINKS], 1)
    return links


def build(x: np.ndarray, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each level the neighbours of its nodes, level of each node) of unit
    rows.  Neighbours count within their level: node j is its j-th."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 12)
    graph = []
    for at in range(int(level.max()) + 1 if n else 1):
        y = x[level >= at] if at else x
        forward = np.full((len(y), LINKS), -1, np.int32)
        near = min(NEAREST, len(y) - 1)
        block = max(1, min(BLOCK, HELD // (4 * NEAREST * x.shape[1])))
        for a in range(0, len(y) if near > 0 else 0, block):
            c, s = _closest(y, a, min(a + block, len(y)), near)
            kept = _diverse(c, s, y, LINKS)
            row, col = np.nonzero(kept)
            forward[a + row, (np.cumsum(kept, 1) - 1)[row, col]] = c[row, col]
        graph.append(_join(y, forward))
    return graph, level


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
    """Ids of the beam of each query, by falling similarity (-1: none).
    start: queries x entry nodes (-1: none)."""
    m, n = len(q), len(x)
    w, step, span = min(ef, start.shape[1]), min(STEP, ef), links.shape[1]
    code = np.full((m, ef), -1, np.int32)  # twice the node, odd once looked behind; -1: none
    code[:, :w] = np.where(start[:, :w] < 0, -1, 2 * start[:, :w])
    sim = np.full((m, ef), -np.inf, np.float32)
    sim[:, :w] = np.where(code[:, :w] >= 0, np.einsum("bed,bd->be", x[start[:, :w]], q), -np.inf)
    seen = np.zeros(m * n, np.uint8)  # 0, or the place in the step that met the node
    row, col = np.nonzero(code >= 0)
    seen[row * n + (code[row, col] >> 1)] = 1
    out, of, first = np.full((m, ef), -1, np.int64), np.arange(m), np.arange(m) * n

    def end(rows: np.ndarray) -> None:
        rank = np.argsort(-sim[rows], axis=1, kind="stable")
        out[of[rows]] = np.take_along_axis(code[rows], rank, 1) >> 1

    while True:
        at = np.arange(len(of))[:, None] * ef
        if step < ef:
            at = at + np.argpartition(np.where(code & 1, np.float32(np.inf), -sim), step - 1, axis=1)[:, :step]
        else:
            at = at + np.arange(ef)
        node = code.take(at)
        on = (node & 1) == 0
        live = on.any(1)
        if live.sum() < 0.8 * len(live) or not len(live):  # ended rows leave now and then
            end(np.flatnonzero(~live))
            code, sim, q, of, first = (y[live] for y in (code, sim, q, of, first))
            if not len(of):
                return out
            continue
        code.reshape(-1)[at.ravel()] = (node | 1).ravel()
        row, col = np.nonzero(on)
        near = links.take(node[on] >> 1, axis=0).ravel()
        there = np.flatnonzero(near >= 0)
        source = there // span
        row, new = row.take(source), near.take(there)
        mark = (col.take(source) * span + there % span + 1).astype(np.uint8)
        key = first.take(row) + new
        left = np.flatnonzero(seen.take(key) == 0)
        key, mark = key.take(left), mark.take(left)
        seen[key] = mark
        left = left.take(np.flatnonzero(seen.take(key) == mark))  # a node behind several counts once
        row, new = row.take(left), new.take(left)
        s = np.einsum("ij,ij->i", x.take(new, axis=0), q.take(row, axis=0))
        left = np.flatnonzero(s > sim.min(1).take(row))
        if not len(left):
            continue
        row, new, s = row.take(left), new.take(left), s.take(left)
        count = np.bincount(row, minlength=len(of))
        wide = ef + int(count.max())
        place = np.arange(len(row)) - (np.cumsum(count) - count).take(row) + row * wide + ef
        more_code, more_sim = np.full((len(of), wide), -1, np.int32), np.full((len(of), wide), np.inf, np.float32)
        more_code[:, :ef], more_sim[:, :ef] = code, -sim
        more_code.reshape(-1)[place], more_sim.reshape(-1)[place] = 2 * new, -s
        top = np.argpartition(more_sim, ef - 1, axis=1)[:, :ef] + np.arange(len(of))[:, None] * wide
        code, sim = more_code.take(top), -more_sim.take(top)


def search(x: np.ndarray, graph: list[np.ndarray], level: np.ndarray, q: np.ndarray, ef: int = EF) -> np.ndarray:
    """Ids of the beam on level 0 of each query."""
    at = np.zeros((len(q), 1), np.int64)  # the first node of the highest level
    nodes = np.flatnonzero(level >= len(graph) - 1)
    for k in range(len(graph) - 1, 0, -1):
        at = beam(x[nodes], graph[k], q, at, 8)
        below = np.flatnonzero(level >= k - 1)
        at, nodes = np.where(at < 0, -1, np.searchsorted(below, nodes[at])), below
    return beam(x, graph[0], q, at, min(ef, max(len(x), 1)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit rows as floats; scaled first, so that no square over- or underflows."""
    out = np.empty(v.shape, np.float32)
    for a in range(0, len(v), TILE):
        u = v[a: a + TILE].astype(np.float64)
        u /= np.abs(u).max(1, keepdims=True)
        out[a: a + TILE] = u / np.linalg.norm(u, axis=1, keepdims=True)
    return out


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Lists of these lengths, null where 0."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values), mask=pa.array(lengths == 0))


def _index_rows(shard: int, dim: int, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's rows, by node and id: the first of a node has its vector, its
    level and its links, those of level 0 first."""
    _, first, node = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * dim}").ravel(), return_index=True, return_inverse=True)
    graph, level = build(_unit(v[first]), seed=shard + 1)
    local = [np.cumsum(level >= k) - 1 for k in range(len(graph))]
    by = np.lexsort((ids, node))
    for a in range(0, len(by), 4096):
        rows = by[a: a + 4096]
        at = node[rows]
        head = at != np.concatenate([[node[by[a - 1]] if a else -1], at[:-1]])
        lengths = np.where(head, 2 * LINKS * (level[at] + 1), 0)
        start, links = np.cumsum(lengths) - lengths, np.empty(lengths.sum(), np.int32)
        for k, g in enumerate(graph):
            has = np.flatnonzero(head & (level[at] >= k))
            links[start[has][:, None] + np.arange(2 * LINKS * k, 2 * LINKS * (k + 1))] = g[local[k][at[has]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), shard, np.int32)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(at.astype(np.int32)), pa.array(ids[rows]), pa.array(level[at].astype(np.int32)),
             _lists(np.where(head, dim, 0), v[rows[head]].ravel()), _lists(lengths, links)],
            names=["shard", "dim", "node", "vec_id", "level", "embedding", "links"])


def index(vectors: DataFrame, rows: int = SHARD_ROWS, least: int = SHARD_LEAST) -> DataFrame:
    """A row per row: its shard and node there, and once a node's vector and links."""
    count, total = vectors.agg(F.count("*"), F.sum("dim")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-count // rows), -(-4 * (total or 0) // SHARD_BYTES))
    shards = max(1, min(-(-count // least), cores), -(-shards // cores) * cores if shards > cores else shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        del kept
        both = np.stack([t.column(c).to_numpy() for c in ("shard", "dim")])
        for shard, dim in np.unique(both, axis=1).T.tolist():
            here = (both == [[shard], [dim]]).all(0)
            part = t if here.all() else t.filter(pa.array(here))
            yield from _index_rows(shard, dim, part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), dim))

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    kind = dict(vectors.dtypes)["embedding"]
    return dealt.repartitionById(shards, "shard").mapInArrow(run, f"shard int, dim int, node int, vec_id long, level int, embedding {kind}, links array<int>")


class Shard:
    """An index read back: ids and vectors by node, graph."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        t = pa.Table.from_batches(parts)
        node, self.ids = t.column("node").to_numpy(), t.column("vec_id").to_numpy()
        heads = np.concatenate([[True], node[1:] != node[:-1]])
        self.first = np.append(np.flatnonzero(heads), len(node))
        self.v = _matrix(t.column("embedding"), dim)
        self.level = t.column("level").to_numpy()[heads]
        links = t.column("links").combine_chunks().flatten().to_numpy().reshape(-1, 2 * LINKS)
        start = np.cumsum(self.level + 1) - self.level - 1
        self.graph = [links[start[self.level >= k] + k] for k in range(int(self.level.max()) + 1)]
        self.unit = _unit(self.v)

    def answer(self, qid: np.ndarray, q: np.ndarray, k: int, ef: int, block: int) -> Iterator[pa.RecordBatch]:
        ask, width, n, dim = np.arange(len(qid)), max(ef, 2 * k), len(self.v), self.v.shape[1]
        unit, again = _unit(q), []
        while len(ask):
            size = max(1, min(block, HELD // max(n, min(width, n) * dim * 8)))
            for a in range(0, len(ask), size):
                part = ask[a: a + size]
                found = search(self.unit, self.graph, self.level, unit[part], min(width, n))
                c, p = self.v[found].astype(np.float64), q[part].astype(np.float64)
                s = np.einsum("bed,bd->be", c, p) / (np.linalg.norm(c, axis=2) * np.linalg.norm(p, axis=1)[:, None])
                s[found < 0] = -np.inf
                out = []
                for i, nodes, t, order in zip(part.tolist(), found, s, np.argsort(-s, axis=1, kind="stable")):
                    own, best, last = int(qid[i]), {}, -np.inf
                    for at in order.tolist():
                        j, score = nodes[at], float(t[at])
                        if j < 0 or score < last:
                            break
                        for e in self.ids[self.first[j]: min(self.first[j + 1], self.first[j] + k + 1)].tolist():  # of a node's ids the smallest are enough
                            if e != own:
                                best.setdefault(e, score)
                        if len(best) >= k and last == -np.inf:
                            last = score
                    if len(best) < k and nodes[-1] >= 0 and width < n:
                        again.append(i)  # the beam is full of copies or of one id's rows
                    else:
                        out += [(own, e, score) for score, e in sorted((-x, e) for e, x in best.items())[:k]]
                if out:
                    of = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(of[0], pa.int64()), pa.array(of[1], pa.int64()), pa.array(-np.array(of[2]))], names=["query_id", "vec_id", "score"])
            ask, width, again = np.array(again, np.int64), width * 8, []


def nearest(built: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF, block_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found in a stored index.
    A shard's task gets the shard's rows, then all queries; it holds the shard
    and one batch of queries."""
    shards = (built.agg(F.max("shard")).first()[0] or 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            shard, dim, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "asks"))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if a == e:
                    continue
                if now != (shard[a], dim[a]):
                    now, parts, held = (shard[a], dim[a]), [], None
                part = b.slice(a, e - a)
                if not asks[a]:
                    parts.append(part)
                elif parts or held:  # else no candidate has this length here
                    held, parts = held or Shard(parts, int(dim[a])), []
                    yield from held.answer(part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), int(dim[a])), k, ef, block_rows)

    rows = built.withColumn("asks", F.lit(False))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(None).cast("int").alias("node"), "vec_id", F.lit(None).cast("int").alias("level"), "embedding",
                           F.lit(None).cast("array<int>").alias("links"), F.lit(True).alias("asks"))
    dealt = rows.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks", "node", "vec_id")
    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Index all rows; search those whose id is divisible by ``every``."""
    v = stored(usable(vectors), "ann-vectors")
    return nearest(stored(index(v), "ann-index"), v.where(F.col("vec_id") % every == 0), k)
