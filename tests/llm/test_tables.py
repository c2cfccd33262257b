"""Sharding, quality rules and vector search against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import MID, collected, texts
from tracefold.llm import ann, rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bits(i) -> str:
    return bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def brute_shards(rows, limit):
    """{(doc_id, n_bytes): shard}, by plain recursion; None where bits end."""
    out = {}

    def split(part, prefix):
        if sum(n for _, n in part) <= limit:
            out.update({r: prefix for r in part})
        elif len({bits(i) for i, _ in part}) == 1:
            out.update({r: None for r in part})
        else:
            for b in "01":
                split([r for r in part if bits(r[0])[len(prefix)] == b], prefix + b)
    split(rows, "")
    return out


@pytest.mark.parametrize("limit", [40, 700, 30_000, 10**9])
def test_sharding(docs, limit):
    rows = [(i, len((t or "").encode())) for i, t in texts()]
    want, got = brute_shards(rows, limit), collected(sharding.shard(docs, limit))
    assert Counter((r[0], r[1]) for r in got) == Counter(rows)
    size, count = defaultdict(int), Counter()
    for i, n, depth, shard, _, _ in got:
        size[shard] += n
        count[shard] += 1
        if want[i, n] is None:
            assert shard.startswith(bits(i) + ".") and depth == 60
        else:
            assert shard == want[i, n] and depth == len(shard)
    for i, n, _, shard, total, docs_in in got:
        assert size[shard] == total and count[shard] == docs_in
        assert total <= limit or count[shard] == 1  # one row alone may be over


def test_sharding_of_one_hot_key(spark):
    rows = spark.createDataFrame([(5 if k % 3 else k, "x" * (k % 50)) for k in range(3000)], "doc_id long, text string").repartition(7)
    got = collected(sharding.shard(rows, 400))
    assert len(got) == 3000
    assert all(r[4] <= 400 for r in got)
    assert sum({r[3]: r[5] for r in got}.values()) == 3000


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k: k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, sym, dup, rep = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
    failed = n < 50 or 100 * rep > 50 * n
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    bad = (4 * sym > n or 2 * dup > len(lines) or chars > 15 * n or chars < 2 * n or 10 * stutter > 3 * n
           or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text)))
    return n, chars, sym, dup, rep, failed, not failed and not bad


def test_rules(docs):
    assert Counter(collected(rules.signals(docs))) == Counter((i, *brute_rules(t)) for i, t in texts())


def test_order_of_rules_never_matters(docs):
    first = Counter(collected(rules.signals(docs, sorted(rules.RULES))))
    assert first == Counter(collected(rules.signals(docs, sorted(rules.RULES, reverse=True))))
    assert set(rules.measure(docs)) == set(rules.RULES)


def test_filter_keeps_rows_and_columns(docs):
    kept = rules.keep_documents(docs)
    assert kept.schema == docs.schema
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for i, t in texts() if brute_rules(t)[-1])


def brute_neighbours(rows, k, every):
    """Every row is a candidate; a pair of ids has the best score of their rows."""
    good = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i].append(np.array(v))
    cos = lambda a, b: float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b)))
    best = lambda q, c: max((cos(a, b) for a in good[q] for b in good[c] if len(a) == len(b)), default=None)
    return {q: sorted((-s, c) for c in good if c != q and (s := best(q, c)) is not None)[:k] for q in good if q % every == 0}


def test_repeated_ids_keep_every_row(spark):
    rows = [(50, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(collected(ann.neighbours(df)))
    assert [(q, r, c) for q, r, c, _ in got] == [(50, 1, 7), (50, 2, 8)] and got[0][3] > 0.9999


def test_one_id_with_very_many_rows_near_a_query(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=6)
    rows = [(9, [float(x) for x in base + rng.normal(size=6) * 1e-3]) for _ in range(900)] + [(100, [float(x) for x in base])]
    rows += [(200 + i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for q, r, c, _ in sorted(collected(ann.neighbours(df))):
        got[q].append(c)
    want = brute_neighbours(rows, 5, 50)
    assert got[100][0] == 9 and got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & {c for _, c in x}) / 5 for q, x in want.items()]) >= 0.9


def test_vectors_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    v = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    v += [(300 + i, v[100][1]) for i in range(20)]                       # copies of a query's vector
    v += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [float("inf")] * 8), (405, []), (None, [1.0] * 8)]
    v += [(450, [1.0, 2.0]), (451, [2.0, 1.0]), (0, v[0][1]), (0, [-x for x in v[0][1]]), (100, v[100][1])]
    df = spark.createDataFrame([(i, x, 3, "s", 1) for i, x in v], "vec_id long, embedding array<double>, rank int, shard string, dim int").repartition(4)
    got = defaultdict(list)
    for q, rank, c, s in collected(ann.neighbours(df)):
        got[q].append((rank, c, s))
    want = brute_neighbours(v, 5, 50)
    assert got.keys() == {q for q, x in want.items() if x}
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert [c for _, c, _ in rows] == [c for _, c in want[q]]
        assert np.allclose([s for _, _, s in rows], [-s for s, _ in want[q]], atol=1e-12)


def test_recall_over_several_shards(spark):
    d = spark.read.parquet(f"{MID}/embeddings.parquet")
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in d.collect()], 5, 50)
    v = ann.usable(d).cache()
    got = defaultdict(set)
    for q, _, c, _ in collected(ann.nearest(ann.index(v, rows=120).cache(), v.where("vec_id % 50 = 0"), block_rows=4)):
        got[q].add(c)
    assert np.mean([len(got[q] & {c for _, c in x}) / 5 for q, x in want.items()]) >= 0.95


def test_graph_recall_on_a_large_shard(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4096, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, level = ann.build(x, 1)
    found, true = ann.search(x, graph, level, x[::16]), np.argsort(-(x[::16] @ x.T), 1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, true)]) >= 0.9


def test_empty_tables(spark, none):
    assert sharding.shard(none, 10).count() == 0 and rules.signals(none).count() == 0 and rules.keep_documents(none).count() == 0
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_known_signals_follow_the_documents():
    s = rules.Signals(pa.array([t for _, t in texts()], pa.string()))
    names = ["words", "lines", "n_words", "n_repeat_words", "n_stutter", "upper", "word_chars", "n_dup_lines"]
    for n in names:
        s.get(n)
    idx = np.array([0, 3, 8, 9, 14, 16, len(texts()) - 1])
    part, fresh = s.take(idx), rules.Signals(s.col.take(pa.array(idx)))
    assert set(names) <= set(part._known)
    for n in names:
        a, b = part.get(n), fresh.get(n)
        assert all((x == y).all() for x, y in zip(a, b)) if isinstance(a, tuple) else (a == b).all()
    assert (part.take(np.array([2, 4])).get("words")[3] == fresh.take(np.array([2, 4])).get("words")[3]).all()
