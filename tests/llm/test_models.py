"""Classifier, language model, language identification and personal data:
contract fields against brute force, models by held-out results."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import MID, collected, texts
from tests.llm.test_tables import WORD
from tracefold.llm import bpe, langid, lm, pii, quality

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def fold(i, mod) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


# -- quality -----------------------------------------------------------------
@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")


def test_quality_on_held_out_rows(sf):
    d, labels = sf
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = collected(quality.classify(d, labels))
    assert len(rows) == d.count() and all(h == (fold(i, 3) == 1) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in rows)
    held = [(y[i], p) for i, h, _, p in rows if h and i in y]
    assert sum(a == b for a, b in held) / len(held) >= 0.97
    bad = [p for a, p in held if a == 0]
    assert bad.count(0) / len(bad) >= 0.8


def test_quality_learns_nothing_from_held_out_labels(sf):
    d, labels = sf
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(collected(quality.classify(d, labels))) == sorted(collected(quality.classify(d, turned)))


def test_quality_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(8, 1), (10, 1), (11, 1), (16, 0), (17, 0), (21, 0), (17, None), (None, 1), (999, 0), (8, 1)], "doc_id long, quality int")
    rows = collected(quality.classify(docs, labels))
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in texts()) and all(0 <= r[2] <= 1 for r in rows)
    no_labels = labels.where("false")
    assert {r[2] for r in collected(quality.classify(docs, no_labels))} == {0.5}
    assert quality.classify(none, labels).count() == 0 and quality.keep_documents(none, labels).count() == 0
    assert quality.keep_documents(docs, no_labels).schema == docs.schema and quality.keep_documents(docs, no_labels).count() == len(texts())


def test_tables_learn_a_pair_effect():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    g = quality.Gam(pair_rounds=40).fit(x[:3000], y[:3000])
    assert ((g.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


# -- language model ----------------------------------------------------------
def brute_base(rows, held=2, mod=7):
    words = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, words) if fold(i, mod) != held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, fold(i, mod) == held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for (i, _), ws in zip(rows, words)]


def compare_base(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[5])
    got, want = sorted((r[:6] for r in got), key=key), sorted(brute_base(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_base_scores(docs):
    rows = collected(lm.score(docs))
    compare_base(rows, texts())
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in rows)


def test_sf_scores_and_held_out_gain(sf):
    d, _ = sf
    src = [(r["doc_id"], r["text"]) for r in d.collect()]
    rows = collected(lm.score(d))
    compare_base(rows, src)
    enc = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    n = dict(zip([i for i, _ in src], [len(x) + 1 for x in enc.encode([t for _, t in src])]))
    c = np.bincount(np.concatenate(enc.encode([t for i, t in src if fold(i, 7) != 2])), minlength=len(enc.token)) + 1.0
    unigram = dict(zip([i for i, _ in src], [float(np.log10(c / c.sum())[x].sum()) for x in enc.encode([t for _, t in src])]))
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > 0.9 * sum(unigram[r[0]] for r in held)  # both negative: well above the subword unigram
    assert all(r[6] < -0.05 * n[r[0]] for r in held)


def test_no_training_row(spark):
    i = next(k for k in range(100) if fold(k, 7) == 2)
    (row,) = collected(lm.score(spark.createDataFrame([(i, "never seen words")], "doc_id long, text string")))
    assert row[:6] == (i, True, 4, 0, 0, 0.0) and row[6] < 0


def small_model():
    m = lm.Attention(50)
    rng = np.random.default_rng(0)
    m.of, m.inside = rng.integers(0, lm.CLASSES, 51), np.log10(rng.random(51))
    return m


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 56, 57, 100])
def test_each_token_is_scored_once(n):
    m, x = small_model(), np.random.default_rng(n).integers(0, 51, n)
    total, line = 0.0, np.concatenate([[m.begin], x])
    for k in range(n):
        j = 0 if k < lm.WINDOW else -(-(k - lm.WINDOW + 1) // (lm.WINDOW - lm.OVERLAP))
        start = j * (lm.WINDOW - lm.OVERLAP)
        z = m._forward(line[None, start: k + 1], k + 1 - start)[-1][-1]
        total += (z[m.of[x[k]]] - np.log(np.exp(z).sum())) / np.log(10) + m.inside[x[k]]
    assert np.allclose(m.score(np.concatenate([x, x]), np.array([0, n, 2 * n])), [total, total], rtol=1e-4)


def test_eight_ids_before_each():
    m, n = small_model(), 120
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = np.random.default_rng(0).integers(0, 51, n)

    def last(x, k):
        return float(np.diff(m.score(np.concatenate([x[:k], x[: k + 1]]), np.array([0, k, 2 * k + 1])))[0])

    for k in range(9, n):
        other = x.copy()
        other[k - 8] = (x[k - 8] + 1) % 50
        # the id eight before k, also where k is the first that its window scores
        before = [last(x, k), last(other, k)]
        assert abs(before[0] - before[1]) > 1e-9, k


def encoded(spark, texts, size):
    rows = [(i, fold(i, 7) == 2, bytearray(np.array([*t, size], lm.id_type(size)).tobytes())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary").repartition(3)


def test_neighbours_of_all_training_documents(spark):
    rng, size = np.random.default_rng(0), 9_500
    texts = [np.stack([rng.permutation(size)[:400], rng.integers(0, 300, 400)], 1).ravel() for _ in range(200)]
    want = np.zeros((size, 2 * lm.HEADS))
    for i, t in enumerate(texts):
        if fold(i, 7) != 2:
            for a, b in zip(t.tolist(), t[1:].tolist()):
                if b < lm.HEADS:
                    want[a, b] += 1
                if a < lm.HEADS:
                    want[b, lm.HEADS + a] += 1
    got = lm.neighbours(encoded(spark, texts, size), np.arange(lm.HEADS), size)
    assert (got == want).all()
    of = lm.cluster(np.ones(size + 1), got)
    assert ((of == lm.CLASSES - 1) == np.append(want.sum(1) == 0, True)).all()  # rare ids and ids beyond 8,000 have a class, too
    assert (of < lm.CLASSES - 1).sum() > 8_000


def test_training_grows_with_the_corpus(spark):
    m, rng = small_model(), np.random.default_rng(0)
    few = [rng.integers(0, 50, 3_200) for _ in range(20)]
    used = [lm.changes(encoded(spark, t, 50), m)[-52:].sum() for t in (few, few * 5)]
    assert used[0] > 0 and 3 < used[1] / used[0] < 7
    before = m.p["emb"].copy()
    m.take(lm.changes(encoded(spark, few, 50), m))
    assert (m.p["emb"] != before).any() and np.abs(m.p["emb"] - before).max() < 0.2


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 65, 2_048, 2_049])
def test_windows_of_pieces_hold_each_id_once(n):
    a, b = np.arange(n + 1), np.arange(5_000, 5_000 + 41)
    start, end = lm.windows_in(np.concatenate([a, b]), np.array([0, n + 1, n + 42]))
    line = np.concatenate([a, b])
    assert sorted(line[x + k] for x, y in zip(start, end) for k in range(1, y - x)) == [*a[1:], *b[1:]]
    assert all(0 < y - x - 1 <= lm.WINDOW for x, y in zip(start, end))


def test_every_window_is_learned_from(spark):
    """Each id of the training documents is read once, those of held-out ones not at all."""
    m, rng = small_model(), np.random.default_rng(3)
    some = [rng.integers(0, 50, n) for n in (1, 5, 31, 32, 33, 700, 2_047, 2_048, 9_001, 400, 64)]
    seen = lm.changes(encoded(spark, some, 50), m, groups=3)[-52:]
    want = np.zeros(52)
    for i, t in enumerate(some):
        if fold(i, 7) != 2:
            want[51] += 1  # the begin
            want += np.bincount(t, minlength=52)
    assert (np.delete(seen, 50) == np.delete(want, 50)).all()  # an end is read only where its window goes on


def test_gradients():
    m = small_model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(1)
    w = rng.integers(0, 51, (4, lm.WINDOW + 1))
    w[2, 20:] = -1

    def loss():
        x, goal = np.where(w[:, :-1] < 0, m.end, w[:, :-1]), w[:, 1:].ravel()
        z, real = m._forward(x, lm.WINDOW)[-1], goal >= 0
        return float(-(z[real, m.of[goal[real]]] - np.log(np.exp(z[real]).sum(1))).mean())

    before = loss()
    m.fit(w, steps=60, batch=4, rate=0.01)
    assert loss() < 0.8 * before


# -- language ----------------------------------------------------------------
def test_language_on_held_out_rows(sf):
    d, _ = sf
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    rows = collected(langid.identify(d))
    assert len(rows) == len(lang) and all(h == (fold(i, 4) == 2) and 0 <= s <= 1 for i, h, _, s, _ in rows)
    held = [(lang[i], p, r) for i, h, p, _, r in rows if h]
    assert sum(a == p for a, p, _ in held) / len(held) >= 0.95
    sure = [(a, p) for a, p, r in held if not r]
    assert sum(a == p for a, p in sure) / len(sure) >= 0.97


def test_language_of_odd_rows(spark, docs, none):
    rows = collected(langid.identify(docs))
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in texts())
    letters = {i: any(map(str.isalpha, t or "")) for i, t in texts() if i is not None}
    assert all((p == "und") == (not letters[i]) and (p != "und" or (s == 0 and r)) for i, _, p, s, r in rows if i is not None)
    assert {r[2] for r in rows} <= {"en", "de", "und"}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[2] for r in collected(langid.identify(unknown))} == {"und"}
    assert langid.identify(none).count() == 0


def test_letters_outside_ascii():
    col = pa.array(["123 é", "12 34", None, "", "日", "٣"])
    from tracefold.llm import flat
    assert langid.has_letter(col, *flat.flat(col)).tolist() == [True, False, False, False, True, False]


# -- personal data -----------------------------------------------------------
def brute_spans(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(digits(m.group()))]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD = ["a@b.c@d.e f@g", "..@x.y-z.", "1.2.3.4.5.6.7.8 999.1.1.1", "é a.b@c.d, x@@y.z +12 +123456789--9", "+1 (434) 555-2368 4111111111111111",
       "4111-1111-1111-1111 0000000255.1.1.1 1..2.3.4", "@", "+", "a" * 3000 + "@" + "b" * 3000 + ".c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"]


def test_base_spans(docs):
    for t in ODD:
        assert pii.base_spans(t) == brute_spans(t), t[:50]
    rows = collected(pii.detect(docs))
    want = Counter()
    for i, t in texts():
        s = brute_spans(t[:20_000].replace("1" * 20_000, "") + t[20_000:] if i == 23 else t)
        if i != 23:
            want[(i, *[sum(k == j for _, k, _ in s) for j in range(4)], hashlib.sha256(pii.show(s).encode()).hexdigest())] += 1
    assert Counter(r[:6] for r in rows if r[0] != 23) == want
    (long,) = [r for r in rows if r[0] == 23]
    assert long[1:5] == (1, 1, 0, 1)


def test_sf_base_spans_stay(sf):
    d, _ = sf
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    added = 0
    for r in pii.detect(d).collect():
        s = brute_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.show(s).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(pii.show(s).split(",") if s else []) <= set(every) and len(every) == len(s) + r["n_added"]
        if not any(c.isdigit() or c in "@+" for c in text[r["doc_id"]]):
            assert not every
        added += r["n_added"]
    assert added < 200


def test_entities_recur_in_other_forms(sf):
    model = pii.train(sf[0])
    t = "reach me at +1 (434) 555-2368 any day. again (434) 555-2368, or in short 555-2368. plain words with version 2.0 and 3."
    base, every = pii.find(pa.array([t]), model)
    assert [t[a:b] for a, _, b in base[0]] == ["+1 (434) 555-2368"]
    found = [t[a:b] for a, k, b in every[0] if k == 3]
    assert len(found) == 3 and all("555-2368" in x for x in found)
    assert "2.0" not in found and pii.redact(t, every[0]).count("<PHONE>") == 3


def skip_only():
    """A model with no evidence but the skip edges'."""
    model = pii.SkipChain()
    model.pair[1] = 8 * np.eye(5) - 4
    return model


def test_entity_recurs_after_plain_words_only():
    t = "call +15551234567 in the morning, otherwise 15551234567"
    base, every = pii.find(pa.array([t]), skip_only())
    assert [t[a:b] for a, _, b in base[0]] == ["+15551234567"]
    assert [t[a:b] for a, k, b in every[0] if k == 3] == ["+15551234567", "15551234567"]
    assert pii.Graph(pa.array(["15551234567 15551234567"])).links.tolist() == [[0, 1, 0]]  # adjacent words have their chain edge only


@pytest.mark.parametrize("t, found", [
    ("at +44 20 7946 0958 by day, else 020 7946 0958 always", "020 7946 0958"),
    ("at +1 (434) 555-2368 by day, else 434 555 2368, always", "434 555 2368"),
    ("at +1 434 555 2368 by day, else 4345552368. Always", "4345552368"),
    ("at +14345552368 by day, else 555 2368 always", "555 2368"),
    ("at +14345552368 by day, else 434 555 2368 2023 times", "434 555 2368"),
    ("at +14345552368 by day, else 434 555 2369 always", None),
    ("paid by 4111 1111 1111 1111 and, as before, with 4111.1111 1111.1111 or so", "4111.1111 1111.1111"),
])
def test_numbers_in_groups_recur(t, found):
    base, every = pii.find(pa.array([t]), skip_only())
    assert len(base[0]) == 1
    assert [t[a:b] for a, _, b in every[0][1:]] == ([found] if found else [])


def test_equal_short_numbers_recur():
    t = "from 10.0.0.1 here, and 12-3456 there, from 10.0.0.1 or 12-3456 and a@b.cd or a@b.cd"
    assert sorted(pii.Graph(pa.array([t])).links.tolist()) == [[0, 2, 1], [1, 3, 1], [4, 5, 1]]


def test_skip_edges_of_numbers_are_few():
    t = "1 22 333 " * 2000 + "0000000 " * 2000 + "1" * 20_000
    assert len(pii.Graph(pa.array([t, None, t])).links) < 2 * 20 * 8001


def test_rare_pairs_count_wherever_they_are(spark):
    plain = spark.range(20_000).selectExpr("id doc_id", "'room ' || id % 90 text")
    rare = spark.range(20_000, 20_030).selectExpr("id doc_id", "'from 10.0.0.1 here, and from 10.0.0.1 there' text")
    seen = []

    def fit(self, x, y, pairs, **how):
        seen.append((int(x[:, -1].sum()), pairs.tolist()))
        return self

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii.SkipChain, "fit", fit)
        pii.train(plain.union(rare))
    assert seen == [(20_060, [[1, 2, 2, 30]])]


def test_redaction_keeps_other_columns(docs, none):
    out = {(r["doc_id"], r["spans"]): r for r in pii.redact_documents(docs).collect() if r["doc_id"] not in (None, 12)}
    assert pii.redact_documents(docs).schema == docs.schema
    for i, t in texts():
        if i not in (None, 12):
            r = out[i, "s"]
            assert r["n_chars"] == len(r["text"] or "") and (r["text"] == t or brute_spans(t))
    assert "<EMAIL>" in out[23, "s"]["text"] and "bob.1@" not in out[23, "s"]["text"]
    assert pii.redact_documents(none).count() == 0 and pii.detect(none).count() == 0


def test_lm_scores_do_not_depend_on_the_layout(spark):
    """Files of another order and number give the same windows, runs and sums."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r for r in lm.score(d.coalesce(1)).collect()}
    two = {r["doc_id"]: r for r in lm.score(d.repartition(7, "text")).collect()}
    assert one.keys() == two.keys()
    for i, r in one.items():
        assert [r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")] == [two[i][c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")]
        assert np.isclose(r["base_score"], two[i]["base_score"], rtol=1e-12) and np.isclose(r["score"], two[i]["score"], rtol=1e-5)


def test_lexicon_sends_words_to_their_chunks(spark):
    """One pass counts each chunk's words; a word's count and ids go to just the chunks that have it."""
    rows = [(i % 5, i % 3 == 0, None if i == 7 else f"Shared w{i % 4} only{i} only{i}\tX") for i in range(40)]
    dealt = spark.createDataFrame(rows, "chunk long, held_out boolean, text string").repartition(4)
    got = [(r["c"], bytes(r["ids"]), sorted(r["chunks"])) for r in lm.lexicon(lm.word_counts(dealt), bpe.load(spark), 3).collect()]
    want, where = Counter(), {}
    for chunk, held, text in rows:
        for w in (text or "").lower().split():
            want[w] += not held
            where.setdefault(w, set()).add(chunk)
    ids = dict(zip(where, bpe.load(spark).value.encode_bytes(list(where))))
    assert sorted(got) == sorted((want[w], bytes(ids[w]), sorted(where[w])) for w in where)
    assert "Join" not in lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().toString()


def test_distinct_ids_of_a_step():
    slot, rng = np.zeros(60, np.intp), np.random.default_rng(0)
    for n in (1, 7, 300):  # what an earlier step left there doesn't matter
        x = rng.integers(0, 60, n)
        some, place = lm.distinct(x, slot)
        assert len(some) == len(set(x.tolist())) and (some[place] == x).all()


def test_learning_follows_the_gradient():
    """After a first step, Adam's mean of each weight is a tenth of the loss's slope, found by differences."""
    m = small_model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(2)
    w = rng.integers(0, 51, (3, lm.WINDOW + 1))
    w[1, 9:] = -1

    def loss():
        x, goal = np.where(w[:, :-1] < 0, m.end, w[:, :-1]), w[:, 1:].ravel()
        z, real = m._forward(x, lm.WINDOW)[-1], goal >= 0
        return float(-(z[real, m.of[goal[real]]] - np.log(np.exp(z[real]).sum(1))).mean())

    slopes = {}
    for k, v in m.p.items():
        for at in rng.integers(0, v.size, 12).tolist():
            was, both = v.flat[at], []
            for by in (1e-5, -1e-5):
                v.flat[at] = was + by
                both.append(loss())
            v.flat[at] = was
            slopes[k, at] = (both[0] - both[1]) / 2e-5
    state = m._state()
    m.learn(w, state, 1, 0.01, sparse=True)
    at, means = 0, {"emb": state[1][1].ravel()}
    for k, v in m.p.items():
        if k != "emb":
            means[k], at = state[0][1][at: at + v.size], at + v.size
    assert all(np.isclose(means[k][i], 0.1 * s, rtol=1e-4, atol=1e-8) for (k, i), s in slopes.items())
