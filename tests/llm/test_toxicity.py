"""Toxicity: exact scoring against plain Python, held-out accuracy, spellings."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import collected, prose, texts
from tracefold.llm import flat as fl
from tracefold.llm import toxicity as T

INSULTS = ["worthless", "pathetic", "disgusting", "scoundrel"]


def plain_mean(text, value):
    """The mean over words of the mean over subwords, from the definition."""
    out = []
    for w in [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if w]:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode())
        one = T.Subwords(*fl.flat(pa.array([w])))
        ids = [int(one.parts[0][0][0])]
        edged = b" " + raw + b" "
        for n in T.GRAMS:
            for k in range(len(edged) - n + 1):
                code = int.from_bytes(edged[k: k + n], "big") + (n << 56)
                ids.append(int(fl.mix(np.array([code], np.uint64))[0] % np.uint64(T.BUCKETS)))
        out.append(sum(value[i] for i in ids) / len(ids))
    return sum(out) / len(out) if out else 0.0


def test_means_and_bags_follow_the_definition():
    value = np.random.default_rng(0).normal(size=T.BUCKETS)
    items = [t if t is None or len(t) < 3000 else t[:3000] for _, t in texts()]
    s = T.Subwords(*fl.flat(pa.array(items, pa.string())))
    want = np.array([plain_mean(t, value) for t in items])
    assert np.allclose(s.means(value), want, atol=1e-9)
    bags = s.bags()
    assert np.allclose([(w * value[f]).sum() for f, w in bags], want, atol=1e-4)
    assert all(len(f) == 0 or abs(w.sum() - 1) < 1e-4 for f, w in bags)


def corpus(n=900, seed=3):
    """Every fourth text holds insults among its words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = prose(1000 + i, int(rng.integers(20, 120))).split(" ")
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 40)):
                words.insert(int(rng.integers(len(words))), str(rng.choice(INSULTS)))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 0.1, 1) for i, t, _ in rows], "doc_id long, text string, lang string, score double, _y int").repartition(4)
    labels = spark.createDataFrame([(i, y, 5, "x") for i, _, y in rows] + [(None, 1, 5, "x"), (7, None, 5, "x"), (5000, 1, 1, "x")], "doc_id long, toxic int, score int, text string")
    return rows, docs, labels


def test_held_out_accuracy_and_spellings(spark, tables):
    rows, docs, labels = tables
    model = T.train(docs, labels)
    truth = {i: y for i, _, y in rows}
    got = collected(T.score(docs, labels, model=model))
    assert len(got) == len(rows)
    held = [(truth[i], p) for i, h, _, p in got if h]
    assert {i for i, h, _, _ in got if h} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([p for y, p in held if y]) > 0.95 and np.mean([p for y, p in held if not y]) < 0.03
    base = prose(77, 40)
    spelt = [base, *(base + " " + w for w in ("worthles", "pathettic", "Disgussting", "scoundrell"))]  # never seen in training
    s = model.scores(T.Subwords(*fl.flat(pa.array(spelt))))
    assert s[0] < 0.5 and (s[1:] > 0.5).all()


def test_same_scores_for_any_layout(spark, tables):
    _, docs, labels = tables
    assert Counter(collected(T.score(docs, labels))) == Counter(collected(T.score(docs.repartition(9, "text"), labels.repartition(5))))


def test_edge_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(texts()) if i is not None], "doc_id long, toxic int")
    got = collected(T.score(docs, labels))
    assert Counter(r[0] for r in got) == Counter(i for i, _ in texts())
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in got)
    assert all(s == 0 and p == 0 for i, _, s, p in got if i in (2, 3))
    empty = labels.where("false")
    assert {(s, p) for _, _, s, p in collected(T.score(docs, empty))} == {(0.0, 0)}
    one = labels.where("toxic = 1")
    assert {s for i, _, s, _ in collected(T.score(docs, one)) if i == 8} == {1.0}
    assert T.score(none, labels).count() == 0
