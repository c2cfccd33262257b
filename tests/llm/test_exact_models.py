"""Trained models against their definitions, written plainly: lookup tables,
averaged embeddings, marginals by enumeration."""

import itertools
import math

import numpy as np
import pyarrow as pa

from tests.llm.conftest import prose, texts
from tracefold.llm import flat as fl
from tracefold.llm import langid, pii, quality


def test_additive_model_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.Gam(rounds=20, pairs=3, pair_rounds=40).fit(x, y)
    got = m.score(x)
    for row, p in zip(x.tolist(), got.tolist()):
        bins = [sum(c <= v for c in cuts.tolist()) for v, cuts in zip(row, m.cuts)]
        total = m.prior + sum(float(t[b]) for t, b in zip(m.tables, bins))
        total += sum(float(t[ci[bins[i]], cj[bins[j]]]) for i, j, ci, cj, t in m.two)
        assert math.isclose(p, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((got > 0.5) == y).mean() > 0.85  # the interaction is learned, no single feature tells it


def test_shallow_trees_take_the_best_cut():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=12), rng.random(12) + 0.1
    m = quality.Gam()
    leaf = lambda a, b: g[a:b].sum() / (h[a:b].sum() + m.ridge)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + m.ridge)
    best = max(range(1, 12), key=lambda k: gain(0, k) + gain(k, 12))
    assert np.allclose(m._tree(g, h, 1), [leaf(0, best)] * best + [leaf(best, 12)] * (12 - best))
    G, H = rng.normal(size=(5, 4)), rng.random((5, 4))
    part = lambda a, s: G[a][:, s].sum() ** 2 / (H[a][:, s].sum() + m.ridge)
    want = max(sum(part(a, s) for a in (slice(0, i), slice(i, 5)) for s in (slice(0, j), slice(j, 4))) for i in range(1, 5) for j in range(1, 4))
    assert math.isclose(m._square(G, H)[0], want, rel_tol=1e-9)


def test_languages_are_means_of_embeddings():
    rows = [(prose(k, 30), "ab"[k % 2]) for k in range(60)]
    rows = [(t.replace("th", "zz") if lang == "a" else t, lang) for t, lang in rows]
    f, off = langid.subwords(*fl.flat(pa.array([t for t, _ in rows])))
    bags = []
    for a, z in zip(off[:-1], off[1:]):
        u, c = np.unique(f[a:z], return_counts=True)
        bags.append((u, c / c.sum()))
    m = langid.Model(["a", "b"]).fit(bags, np.array(["ab".index(x) for _, x in rows]))
    got = m.scores(f, off)
    for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        mean = [math.fsum(float(m.table[i, j]) for i in f[a:z].tolist()) / (z - a) for j in range(2)]
        e = [math.exp((v + float(b)) * m.heat) for v, b in zip(mean, m.bias)]
        assert np.allclose(got[k], np.array(e) / sum(e), atol=1e-5)
    assert (got.argmax(1) == ["ab".index(x) for _, x in rows]).mean() > 0.9


def test_subwords_are_words_and_their_grams():
    items = [t if t is None or len(t) < 400 else t[:400] for _, t in texts()]
    buf, off = fl.flat(pa.array(items, pa.string()))
    _, first = langid.subwords(buf, off)
    for t, n in zip(items, np.diff(first).tolist()):
        words = "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ")
        sizes = [len(w.encode()) + 2 for w in words if w]
        assert n == sum(1 + max(s - 2, 0) + max(s - 3, 0) for s in sizes)


class Small(pii.Graph):
    """A graph without texts: unary features and links as given."""

    def __init__(self, unary, links):
        self.unary, self.links, self.doc = unary, np.array(links, np.int64).reshape(-1, 3), [0] * len(unary)
        self.label = np.zeros(len(unary), np.int64)

    def matrix(self):
        return self.unary


def test_marginals_of_a_tree_equal_enumeration():
    """Message passing is exact where links form no loop."""
    rng = np.random.default_rng(4)
    k = 1 + len(pii.KINDS)
    for links in ([], [(0, 1, 0)], [(0, 1, 0), (1, 2, 0), (2, 3, 1)], [(0, 1, 0), (0, 2, 1), (0, 3, 1)]):
        m = pii.SkipChain()
        m.w = np.eye(k)
        half = rng.normal(size=(2, k, k))
        m.pair = half + half.transpose(0, 2, 1)  # links have no direction
        unary = rng.normal(size=(4, k))
        want = np.zeros((4, k))
        for labels in itertools.product(range(k), repeat=4):
            p = math.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(m.pair[t, labels[i], labels[j]] for i, j, t in links))
            for i, x in enumerate(labels):
                want[i, x] += p
        want /= want.sum(1, keepdims=True)
        got = m.label(Small(unary, links))
        assert np.abs(got - want).max() < 0.02  # a fixed number of damped rounds
