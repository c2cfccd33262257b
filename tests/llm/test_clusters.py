"""Centroid clustering against a full scan in plain integers."""

import hashlib

import numpy as np
import pytest

from tests.llm.conftest import collected
from tracefold.llm import kmeans


def brute(rows, k=16, rounds=3):
    ok = lambda v: v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) <= 2 ** 21 for x in v)
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if ok(v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cent = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(cent)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                cent[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    per = [sum(d for d, a in last if a == j) for j in range(len(cent))]
    tag = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, a, d, per[a], sum(per), tag[a]) for (i, _), (d, a) in zip(kept, last)), key=str)


def table(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, v, 1, 2, 0.5, "x") for i, v in rows], f"vec_id long, embedding {kind}, cluster int, first int, distance double, v string").repartition(4)


def rows(seed, n, scale):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, 64)) * scale
    out = [(int(i), [float(x) for x in centre[i % 9] + rng.normal(size=64) * 0.2]) for i in range(n)]
    out += [(int(i), out[0][1]) for i in range(n, n + 40)]                                      # a common vector
    out += [(3, out[5][1]), (3, out[3][1]), (3, out[3][1]), (None, out[7][1])]                    # repeated and null ids
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")], [1.0] * 63 + [1e30]]
    return out + [(900 + j, v) for j, v in enumerate(bad)] + [(990, [0.0] * 64), (991, [-0.001] * 64), (992, [2.0 ** 21] * 64)][: 2 if scale < 9 else 3]


@pytest.mark.parametrize("seed,n,scale", [(1, 200, 0.3), (2, 150, 10.0), (3, 3, 0.3)])
def test_equals_a_full_scan(spark, seed, n, scale):
    data = rows(seed, n, scale)
    assert sorted(collected(kmeans.cluster(table(spark, data))), key=str) == brute(data)


def test_ties_and_few_vectors(spark):
    data = [(i, [float(i % 2)] * 64) for i in range(50)]          # two distinct vectors, sixteen centroids
    assert sorted(collected(kmeans.cluster(table(spark, data))), key=str) == brute(data)
    data = [(4, [0.5] * 64)]
    assert collected(kmeans.cluster(table(spark, data))) == brute(data)


def test_no_vectors(spark):
    assert kmeans.cluster(table(spark, [])).count() == 0
    assert kmeans.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0


def test_search_keeps_exact_results_and_skips_work():
    rng = np.random.default_rng(5)
    centre = rng.integers(-400, 400, size=(40, 16))
    v = centre[rng.integers(0, 40, 4000)] + rng.integers(-30, 31, size=(4000, 16))
    cent, b, work = v[:40].copy(), kmeans.Bounds.unknown(len(v)), []
    for _ in range(6):
        work.append(kmeans.assign(v, cent, b))
        d = ((v[:, None, :] - cent[None]) ** 2).sum(2)
        assert (b.first == d.argmin(1)).all()                     # argmin: the smaller number of equals
        two = np.sort(d, 1)
        assert (b.upper * (1 + 1e-9) >= np.sqrt(two[:, 0])).all() and (b.lower * (1 - 1e-9) <= np.sqrt(two[:, 1])).all()
        new = np.stack([np.floor_divide(v[b.first == j].sum(0), max((b.first == j).sum(), 1)) if (b.first == j).any() else cent[j] for j in range(40)])
        b.moved(np.sqrt(((new - cent) ** 2).sum(1)) * (1 + 1e-9))
        cent = new
    assert work[0] < 4000 * 40 and work[-1] < 4000 * 8
