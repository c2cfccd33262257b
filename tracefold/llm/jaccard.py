"""N-gram Jaccard join: all documents whose shingle sets have a similarity
of THRESHOLD or more, as connected components.

Signatures (partition of the universe, pigeonhole).  Shingle hashes are the
universe.  Sets are compared within size bands; in the scheme of a band the
universe is cut into segments by hash.  A set takes part in the scheme of its
own band and, as the smaller side, in the next one, and indexes all its
segments that aren't empty.  D is the most shingles in which it can differ
from a partner of the scheme: of any D + 1 of its segments a partner has at
least one unchanged, and indexes it.

Cost-based allocation.  A set with more than D segments probes with D + 1 of
them (error budget 0) and leaves out those that the most other sets share
(budget -1), so frequent passages and lines make no candidates.  A set with
fewer raises all its segments to budget 1: it also indexes one-deletion
neighbourhoods, in which such sets meet; if even that is too little, it
indexes one signature for the whole scheme.  Sets with too few segments, and
sets that would still probe a group of more than DEAR rows, don't probe
there: the others find them, and among themselves they meet by segments of
one shingle, each probing with the least shared shingles, one more than a
partner may lack, of two components the smaller one's sets only.  The group
sizes are true counts over all sets.

Candidates are verified exactly on the whole texts.  Sets that are equal are
one node from the start.  In HUB_TURNS turns nodes are compared with a hub
of the largest component of their groups; groups that fall into one
component are settled, and only pairs of different components are listed
from the rest.  Two exact filters go before the texts: sizes, and the
distance of bucket counts, which never exceeds the sets' difference.

Defined results: a null or empty text, or one without words, has no shingle
and is a component of its own; fewer than five words are one shingle; a
component is named by its smallest id that is not null (null if it has
none); repeated rows are in one component by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm import flat as fl
from tracefold.llm.common import bounded, stored

#: Similarity >= 75/100 and five-word shingles; the formulas below follow from 3/4.
SHINGLE, BUCKETS, PAIRS_OF_HUB = 5, 96, 400
#: A set that would probe a group of more rows than this meets others by single shingles.
DEAR, HUB_TURNS = 24, 5
FEW = 1_000_000
_U = np.uint64


def difference(total: int) -> int:
    """Most shingles outside the intersection of two sets of that total size."""
    return total // 7


def bands(most: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) of the bands up to size ``most``."""
    out, low = [], 1
    while not out or out[-1][1] < most * 2:
        high = max(low, low * 3 // 2)
        out.append((low, high, -(-6 * (difference(2 * high) + 1) // 5) + 2))
        low = high + 1
    return out


def _segments(h: np.ndarray, m: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)


def signatures(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, kind, tag) rows of one sorted set.  kind 0: exact, 1: one
    deletion, 2: an empty segment.  tag // 2000: how many rows of its scheme
    the set need not probe with (FEW: it has too few to find all partners by
    them); tag % 2000 names the scheme."""
    n = len(h)
    sig, kind, scheme, spare = [], [], [], []
    table = bands(n)
    own = next(k for k, (a, b, _) in enumerate(table) if a <= n <= b)
    mixed = fl.mix(h)
    for k in (own, own + 1):
        low, high, m = table[k]
        partner = min(high, 4 * n // 3)
        if partner < low:
            continue
        d = difference(n + partner)
        seg = _segments(h, m)
        heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        which, value = seg[heads], np.add.reduceat(mixed, heads)
        name = lambda v, s, space: fl.mix(v ^ fl.mix(s.astype(_U) + _U((k * 3 + space) << 40)))
        few = len(heads) <= d
        sig.append(name(value, which, 0))
        kind.append(np.zeros(len(heads), np.int8))
        spare.append(np.full(len(heads), FEW if few else len(heads) - d - 1))
        scheme.append(np.full(len(heads), k))
        if few:
            void = np.setdiff1d(np.arange(m), which)
            left = np.repeat(value, np.diff(np.append(heads, n))) - mixed
            extra = [name(value, which, 1), name(left, seg, 1), name(np.zeros(len(void), _U), void, 1)]
            kinds = [0, 1, 2]
            if 2 * len(heads) <= d:
                extra.append(name(np.ones(1, _U), np.zeros(1, np.int64), 2))
                kinds.append(0)
            for e, c in zip(extra, kinds):
                sig.append(e)
                kind.append(np.full(len(e), c, np.int8))
                spare.append(np.zeros(len(e), np.int64))
                scheme.append(np.full(len(e), k + 1000))
    return np.concatenate(sig), np.concatenate(kind), np.concatenate(spare) * 2000 + np.concatenate(scheme)


def _digest(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    out = []
    for salt in (0x51ED27, 0xA17F3B):
        c = np.concatenate([[_U(0)], np.cumsum(fl.mix(h ^ _U(salt)), dtype=_U)])
        out.append(fl.mix(c[off[1:]] - c[off[:-1]]).view(np.int64))
    return out[0], out[1]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the shingle set), the set's digest, and how many
    shingles fall into each of BUCKETS hash buckets."""
    def run(batches):
        for b in fl.slices(batches):
            h, off = fl.shingle_sets(*fl.flat(b.column("text")), SHINGLE)
            d1, d2 = _digest(h, off)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            c = np.bincount(doc * BUCKETS + (h % _U(BUCKETS)).astype(np.int64), minlength=(len(off) - 1) * BUCKETS).reshape(-1, BUCKETS)
            c = np.minimum(c, 65535).astype("<u2")  # a cut count can only bring two sets nearer
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(d1), pa.array(d2), pa.array([x.tobytes() for x in c], pa.binary())],
                                             ["doc_id", "n", "d1", "d2", "counts"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n long, d1 long, d2 long, counts binary")


def _with_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` with the text of their document.  A repeated id may
    bring other texts too; the digest tells them apart later."""
    n = bounded(nodes)
    return docs.select(F.col("doc_id").alias("_id"), "text").join(n, F.col("_id").eqNullSafe(n["doc_id"])).drop("_id", "doc_id")


def _own(b: pa.RecordBatch, off: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return np.flatnonzero((b.column("n").to_numpy() == np.diff(off)) & (b.column("d1").to_numpy() == d1) & (b.column("d2").to_numpy() == d2))


def index(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node, n, kind, tag) rows of every node."""
    def run(batches):
        for b in fl.slices(batches, max_bytes=1 << 20):
            h, off = fl.shingle_sets(*fl.flat(b.column("text")), SHINGLE)
            node, n = b.column("node").to_numpy(), np.diff(off)
            rows = [(i, *signatures(h[off[i]: off[i + 1]])) for i in _own(b, off, *_digest(h, off)).tolist()]
            if not rows:
                continue
            size = [len(r[1]) for r in rows]
            who = np.repeat([r[0] for r in rows], size)
            tag = np.concatenate([r[3] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)), pa.array(node[who]), pa.array(n[who].astype(np.int32)),
                 pa.array(np.concatenate([r[2] for r in rows])), pa.array(tag.astype(np.int64))], ["sig", "node", "n", "kind", "tag"])

    return _with_texts(docs, nodes).mapInArrow(run, "sig long, node long, n int, kind byte, tag long")


def _sizes_fit(a, b):
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Drop pairs whose bucket counts differ by more than their sets may."""
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, BUCKETS).astype(np.int32) for c in ("ca", "cb"))
            near = np.abs(x - y).sum(1) <= (b.column("na").to_numpy() + b.column("nb").to_numpy()) // 7
            yield b.select(["a", "b"]).filter(pa.array(near))

    s = bounded(sketches, 100_000)  # 200 bytes a row
    both = (pairs.join(s.select(F.col("node").alias("a"), F.col("counts").alias("ca")), "a")
            .join(s.select(F.col("node").alias("b"), F.col("counts").alias("cb")), "b").select("a", "b", "na", "nb", "ca", "cb"))
    return both.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the whole texts.  The texts of the pairs
    of one a stream past its set; an a with many pairs is salted."""
    many = stored(pairs.groupBy("a").count().where(F.col("count") > PAIRS_OF_HUB).select("a", F.ceil(F.col("count") / PAIRS_OF_HUB).cast("int").alias("_s")), "jaccard-many")
    salt = F.pmod(F.hash("b"), F.coalesce("_s", F.lit(1)))
    salted = stored(pairs.join(bounded(many), "a", "left").withColumn("salt", salt).select("a", "b", "salt"), "jaccard-pairs")
    known = bounded(nodes)
    hubs = salted.select("a", "salt").distinct().join(known, F.col("a") == F.col("node")).withColumn("b", F.lit(None).cast("long"))
    members = salted.join(known, F.col("b") == F.col("node"))
    cols = ["a", "salt", "b", "doc_id", "n", "d1", "d2"]
    asked = stored(hubs.select(cols).unionByName(members.select(cols)), "jaccard-asked")
    rows = _with_texts(docs, asked).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        at, hub = None, None
        for b in fl.slices(batches):
            h, off = fl.shingle_sets(*fl.flat(b.column("text")), SHINGLE)
            a, salt, member = (b.column(c).to_pylist() for c in ("a", "salt", "b"))
            out_a, out_b = [], []
            for i in _own(b, off, *_digest(h, off)).tolist():
                own = h[off[i]: off[i + 1]]
                if member[i] is None:
                    at, hub = (a[i], salt[i]), own.copy()
                    continue
                assert at == (a[i], salt[i]), "a pair's texts are apart"
                short, long = (own, hub) if len(own) <= len(hub) else (hub, own)
                pos = np.searchsorted(long, short)
                common = int((long[np.minimum(pos, len(long) - 1)] == short).sum())
                if 100 * common >= 75 * (len(own) + len(hub) - common):
                    out_a.append(a[i])
                    out_b.append(member[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, for nodes with an edge; rounds of
    large-star and small-star joins until only stars are left."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        e = stored(e, "stars")
        role = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        role = role.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if role.where("ups > 1 or (ups = 1 and least = 0)").isEmpty():  # every node has one parent, a root
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        e = large.join(low, "u").select(F.explode(F.array(pair("v"), pair("u"))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _merged(comp: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components after more edges: the edges are contracted to the components
    they join, so each search is over a small graph."""
    if comp is None:
        return stored(components(edges), "jaccard-components")
    ends = _named(_named(edges, comp, "a").withColumnRenamed("comp", "ca"), comp, "b").select(F.col("ca").alias("a"), F.col("comp").alias("b"))
    new = stored(components(ends), "jaccard-merged")
    old = _named(comp.withColumnRenamed("comp", "c"), new, "c").select("node", "comp")
    first = new.select("node", F.col("comp").alias("c")).join(bounded(comp.select("node")), "node", "left_anti")  # nodes without a link before
    return stored(old.union(first.select("node", "c")), "jaccard-components")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the signatures that nodes of several components share, and how
    many rows share them."""
    w = Window.partitionBy("sig")
    rows = rows.withColumn("_c", F.count("*").over(w)).withColumn("_lo", F.min("comp").over(w)).withColumn("_hi", F.max("comp").over(w))
    return rows.where("_lo <> _hi").drop("_lo", "_hi")


def _met(probes: DataFrame, rows: DataFrame, also: str) -> DataFrame:
    """Pairs (a, b, na, nb) of different components on one signature."""
    p, q = probes.alias("p"), rows.alias("q")
    first = F.col("p.node") < F.col("q.node")
    pick = lambda c, name: F.when(first, F.col(f"p.{c}")).otherwise(F.col(f"q.{c}")).alias(name)
    back = lambda c, name: F.when(first, F.col(f"q.{c}")).otherwise(F.col(f"p.{c}")).alias(name)
    return (p.join(q, F.col("p.sig") == F.col("q.sig")).where(f"p.comp <> q.comp and {also}").where(_sizes_fit(F.col("p.n"), F.col("q.n")))
            .select(pick("node", "a"), back("node", "b"), pick("n", "na"), back("n", "nb")).distinct())


def _elements(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node, n, comp, big): a row for each shingle of the nodes."""
    def run(batches):
        for b in fl.slices(batches, max_bytes=1 << 20):
            h, off = fl.shingle_sets(*fl.flat(b.column("text")), SHINGLE)
            for i in _own(b, off, *_digest(h, off)).tolist():
                x = h[off[i]: off[i + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), *[pa.repeat(b.column(c)[i], len(x)) for c in ("node", "n", "comp", "big")]], ["sig", "node", "n", "comp", "big"])

    return _with_texts(docs, nodes).mapInArrow(run, "sig long, node long, n long, comp long, big long").withColumn("n", F.col("n").cast("int"))


def _named(df: DataFrame, comp: DataFrame, node: str = "node") -> DataFrame:
    """df with the component of its node (itself without a link)."""
    c = comp.select(F.col("node").alias(node), F.col("comp").alias("_f"))
    return df.join(bounded(c), node, "left").withColumn("comp", F.coalesce("_f", F.col(node))).drop("_f")


def _with_hubs(rows: DataFrame, turn: int) -> DataFrame:
    """Rows of the groups that hold several components, with a hub: a node of
    the group's largest component."""
    w = Window.partitionBy("sig")
    size = F.count("*").over(Window.partitionBy("sig", "comp"))
    chance = F.xxhash64("node", "sig", F.lit(turn)) if turn else F.xxhash64("node")  # later turns: another hub in each group
    rows = rows.withColumn("_s", size).withColumn("hub", F.max(F.struct("_s", "comp", chance.alias("x"), "node", "n")).over(w))
    return rows.withColumn("_c", F.count("*").over(w)).where(F.col("_s") < F.col("_c")).drop("_s", "_c")


def _hub_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, na, nb) of a hub and a node of another component; for each
    node the hubs of most of its groups."""
    met = rows.where("comp <> hub.comp").where(_sizes_fit(F.col("n"), F.col("hub.n"))).groupBy("node", "n", F.col("hub.node").alias("_h"), F.col("hub.n").alias("hub_n")).count()
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "_h"))
    met = met.withColumn("_r", best).where(F.col("_r") <= most)
    return met.select(F.col("_h").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows (doc_id, n, d1, d2) and, for each class of equal sets, its
    component's name and whether it is the component's first class."""
    docs = docs.select("doc_id", "text")
    rows = stored(digests(docs).withColumn("_row", F.monotonically_increasing_id()), "jaccard-digests")
    nodes = stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("_row").alias("node"), F.min("doc_id").alias("doc_id")), "jaccard-nodes")
    w = Window.partitionBy("sig")
    shared = stored(index(docs, nodes).withColumn("_c", F.count("*").over(w)).where("_c > 1").drop("_c"), "jaccard-shared")
    used = shared.select("node").distinct()
    sketches = stored(rows.select(F.col("_row").alias("node"), "counts").join(bounded(stored(used, "jaccard-used")), "node", "left_semi"), "jaccard-sketches")
    asked = comp = None

    def compare(met: DataFrame) -> int:
        """Verify pairs that weren't verified before; how many link."""
        nonlocal asked, comp
        if asked is not None:
            seen = bounded(asked)
            met = met.join(seen, [F.least(met["a"], met["b"]) == seen["x"], F.greatest(met["a"], met["b"]) == seen["y"]], "left_anti")
        near = stored(_near(met, sketches), "jaccard-near")
        linked = stored(verify(near, docs, nodes), "jaccard-edges")
        pairs = near.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        asked = pairs if asked is None else asked.union(pairs)
        comp = _merged(comp, linked)
        return linked.count()

    rows_of, first_links = shared.withColumn("comp", F.col("node")), 0
    for turn in range(HUB_TURNS):
        open_ = stored(_with_hubs(rows_of, turn), "jaccard-open")
        links = compare(_hub_pairs(open_, 1 if turn == 0 else 4))
        rows_of = _named(open_.drop("comp", "hub"), comp)
        first_links = first_links or links
        if 100 * links <= first_links:  # hubs find hardly anything new; the rest is listed below
            break
    open_ = _open(rows_of)

    # groups that still hold several components: each node probes with all but its most shared segments
    own = Window.partitionBy("node", "tag")
    rank = F.row_number().over(own.orderBy(F.desc("_c"), "sig"))
    spare = F.floor(F.col("tag") / 2000)
    open_ = open_.withColumn("probe", rank > spare)
    cost = F.coalesce(F.max(F.when(F.col("probe"), F.col("_c"))).over(own), F.lit(0))
    open_ = stored(open_.withColumn("dear", (cost > DEAR) | (spare >= FEW)), "jaccard-open")
    met = _met(open_.where("probe and not dear"), open_, "not (p.kind = 2 and q.kind = 2)")

    # nodes that would probe groups over DEAR (mostly frequent passages) meet by single shingles, least shared
    # first; of two components the smaller one's nodes look for the larger one's
    dear = stored(open_.where("dear").select("node", "comp").distinct(), "jaccard-dear")
    size = comp.groupBy("comp").agg(F.count("*").alias("_b"))
    dear = dear.join(bounded(stored(size, "jaccard-sizes")), "comp", "left").withColumn("big", F.coalesce("_b", F.lit(1))).drop("_b")
    single = _open(_elements(docs, nodes.join(bounded(dear), "node")))
    place = F.struct("big", "comp")
    single = single.withColumn("up", place < F.max(place).over(Window.partitionBy("sig")))
    own = Window.partitionBy("node", "up")
    settled = F.col("n") - F.count("*").over(own)  # shingles that no larger component's node has come first
    single = single.withColumn("pos", F.when(F.col("up"), F.row_number().over(own.orderBy("_c", "sig")) + settled))
    single = stored(single, "jaccard-single")
    # a set lacks at most n - overlap of its shingles in a partner; overlap >= 3/7 of both sizes
    w = Window.partitionBy("sig")
    for turn in range(2):  # hubs once more, for those that would list pairs
        now = _named(single.withColumnRenamed("comp", "was"), comp)
        hub = F.max(F.struct("big", "was", F.xxhash64("node", "sig", F.lit(turn)).alias("x"), "node", "n", "comp")).over(w)
        compare(_hub_pairs(now.withColumn("hub", hub).where("pos <= n + 1 - floor((3 * (n + hub.n) + 6) / 7)"), 8))
    now = _named(single.withColumnRenamed("comp", "was"), comp)
    near_enough = "struct(p.big, p.was) < struct(q.big, q.was) and p.pos <= p.n + 1 - floor((3 * (p.n + q.n) + 6) / 7)"
    met = met.union(_met(now.where("pos <= n / 4 + 1"), now, near_enough)).distinct()
    compare(stored(met, "jaccard-met"))

    named = _named(nodes, comp)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    names = named.groupBy("comp").agg(F.min(first).alias("_f")).select("comp", F.col("_f.doc_id").alias("component_id"), F.col("_f.node").alias("_w"))
    named = named.join(names, "comp").select("n", "d1", "d2", "component_id", (F.col("node") == F.col("_w")).alias("first"), F.col("doc_id").alias("class_id"))
    return rows.select("doc_id", "n", "d1", "d2"), stored(named, "jaccard-names")


def join_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows, named = _classes(docs)
    out = rows.join(bounded(named), ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows, all columns, of one document of each component: the one with
    its smallest id (a row without id only if none has one).  Of rows that
    share that id and shingle set one stays; rows without words all stay."""
    rows, named = _classes(docs)
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    n, d1, d2 = free + "n", free + "d1", free + "d2"

    def run(batches):
        for b in fl.slices(batches):
            h, off = fl.shingle_sets(*fl.flat(b.column("text")), SHINGLE)
            x, y = _digest(h, off)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(off), pa.int64()), pa.array(x), pa.array(y)], [*b.schema.names, n, d1, d2])

    known = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in (n, d1, d2)]]))
    found = rows.join(bounded(named), ["n", "d1", "d2"])
    found = stored(found.groupBy("doc_id", "n", "d1", "d2").agg(F.count("*").alias("c"), F.first(F.col("first") & F.col("class_id").eqNullSafe(F.col("doc_id"))).alias("stays")), "jaccard-found")

    def same(other: DataFrame):
        return known["doc_id"].eqNullSafe(other["doc_id"]) & (known[n] == other["n"]) & (known[d1] == other["d1"]) & (known[d2] == other["d2"])

    gone = bounded(found.where("not stays").select("doc_id", "n", "d1", "d2"))
    again = found.where("stays and c > 1").select("doc_id", "n", "d1", "d2")
    if again.isEmpty():
        return known.join(gone, same(gone), "left_anti").drop(n, d1, d2)
    known = known.join(gone, same(gone), "left_anti")
    again = bounded(again)
    rest = known.join(again, same(again), "left_anti").drop(n, d1, d2)
    most = F.struct(F.xxhash64("text"), "text")
    pick = known.join(again, same(again), "left_semi").groupBy("doc_id", n, d1, d2).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), most).alias("r"))
    return rest.unionByName(pick.select("r.*"))
