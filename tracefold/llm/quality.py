"""Quality classifier: a generalised additive model with pairwise
interactions.

Cyclic boosting visits one feature after another and adds a shallow tree
(up to four leaves) over that feature's bins to its lookup table, so the
model ends as one table per feature; then pairs of features, picked by how
much residual a four-leaf tree explains, get two-way tables the same way.
A document's score is the sum of its bins' entries, through a logistic.

Labels are learned from a bounded sample (SAMPLE rows, by hash order) of the
labelled rows that are not held out; features are computed from the whole
text of every document.  Neither label, language, source nor id is a
feature.

Defined results: a null or empty text has all features 0 and is scored like
any other; a null label is no label; a repeated label row counts once, by
its largest value.  Without labels of both kinds the score is the constant
prior (0.5 without any label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import flat as fl
from tracefold.llm.common import crc_remainder
from tracefold.llm.rules import Signals, per_doc

SAMPLE = 40_000
FEATURES = ("log_words", "word_chars", "symbols", "upper", "digits", "punctuation", "exclaims", "bars", "non_ascii",
            "spaces", "copied_lines", "words_per_line", "repeats", "stutter", "distinct", "longest_word", "ends", "sentences")

_CLASS = np.zeros(256, np.uint8)
for _bytes, _k in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"#*$%&<>", 4), (b".,;:?'\"()-", 5), (b"!", 6),
                   (b"|", 7), (range(128, 256), 8), (b" \t\n\r\x0b\x0c", 9)):
    _CLASS[list(_bytes)] = _k


def features(s: Signals) -> np.ndarray:
    """One row of FEATURES for each document of the slice."""
    n = len(s.off) - 1
    size = np.diff(s.off)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 10 + _CLASS[s.buf], minlength=n * 10).reshape(n, 10) if n else np.zeros((0, 10))
    starts, ends, woff, wh = s.get("words")
    nw = np.diff(woff)
    words, chars, lines = np.maximum(nw, 1), np.maximum(size, 1), s.get("n_lines")
    of = fl.doc_of(woff)
    key = wh ^ fl.mix(of.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    distinct = np.bincount(of[order[first]], minlength=n)
    heads = woff[:-1][nw > 0]
    longest = np.zeros(n)
    if len(heads):
        longest[nw > 0] = np.maximum.reduceat(ends - starts, heads)
    last = s.buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stops = per_doc(np.isin(last, np.frombuffer(b".!?", np.uint8)), woff)
    out = np.stack([
        np.log1p(nw), s.get("word_chars") / words, kinds[:, 4] / words, kinds[:, 1] / np.maximum(kinds[:, 1] + kinds[:, 2], 1),
        kinds[:, 3] / chars, kinds[:, 5] / words, kinds[:, 6] / words, kinds[:, 7] / words, kinds[:, 8] / chars, kinds[:, 9] / chars,
        s.get("n_dup_lines") / np.maximum(lines, 1), nw / np.maximum(lines, 1), s.get("n_repeat_words") / words, s.get("n_stutter") / words,
        distinct / words, longest, stops / np.maximum(lines, 1), nw / (stops + 1)], axis=1)
    out[nw == 0] = 0
    return out.astype(np.float32)


class Gam:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, bins: int = 32, rounds: int = 60, pairs: int = 6, pair_rounds: int = 12, rate: float = 0.15, ridge: float = 2.0):
        self.bins, self.rounds, self.pairs, self.pair_rounds, self.rate, self.ridge = bins, rounds, pairs, pair_rounds, rate, ridge
        self.prior, self.cuts, self.tables, self.two = 0.0, [], [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
        """Leaf value of each bin of a shallow tree on summed gradients."""
        value = np.full(len(g), g.sum() / (h.sum() + self.ridge))
        if depth == 0 or len(g) < 2:
            return value
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] <= g.sum() ** 2 / (h.sum() + self.ridge) + 1e-12:
            return value
        return np.concatenate([self._tree(g[:k], h[:k], depth - 1), self._tree(g[k:], h[k:], depth - 1)])

    def _square(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Best four-leaf tree over two features' bins: its gain and values."""
        pad = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        G, H = pad(g), pad(h)
        a, b = G.shape[0] - 1, G.shape[1] - 1
        best, parts = np.zeros((a - 1, b - 1)), []
        for i0, j0 in ((0, 0), (0, 1), (1, 0), (1, 1)):
            q = [(S[1:a, 1:b] if (i0, j0) == (0, 0) else S[1:a, b:] - S[1:a, 1:b] if (i0, j0) == (0, 1) else
                  S[a:, 1:b] - S[1:a, 1:b] if (i0, j0) == (1, 0) else S[a:, b:] - S[a:, 1:b] - S[1:a, b:] + S[1:a, 1:b]) for S in (G, H)]
            best = best + q[0] ** 2 / (q[1] + self.ridge)
            parts.append(q[0] / (q[1] + self.ridge))
        i, j = np.unravel_index(np.argmax(best), best.shape)
        out = np.empty((a, b))
        out[: i + 1, : j + 1], out[: i + 1, j + 1:], out[i + 1:, : j + 1], out[i + 1:, j + 1:] = (p[i, j] for p in parts)
        return float(best[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Gam":
        if len(y) == 0:
            return self
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        width = [len(c) + 1 for c in self.cuts]
        self.tables = [np.zeros(w) for w in width]
        f = np.full(len(y), self.prior)
        grad = lambda: (lambda q: (y - q, np.maximum(q * (1 - q), 1e-6)))(1 / (1 + np.exp(-f)))
        for _ in range(self.rounds):
            for j, w in enumerate(width):
                g, h = grad()
                step = self.rate * self._tree(np.bincount(b[:, j], g, w), np.bincount(b[:, j], h, w))
                self.tables[j] += step
                f = f + step[b[:, j]]
        coarse = [np.minimum(np.arange(w) * 8 // w, 7) for w in width]
        c = np.stack([m[b[:, j]] for j, m in enumerate(coarse)], axis=1)
        g, h = grad()
        cell = lambda i, j, v: np.bincount(c[:, i] * 8 + c[:, j], v, 64).reshape(8, 8)
        gains = sorted(((self._square(cell(i, j, g), cell(i, j, h))[0], i, j) for i in range(len(width)) for j in range(i)), reverse=True)
        self.two = [(i, j, coarse[i], coarse[j], np.zeros((8, 8))) for _, i, j in gains[: self.pairs]]
        for _ in range(self.pair_rounds):
            for i, j, _, _, t in self.two:
                g, h = grad()
                step = self.rate * self._square(cell(i, j, g), cell(i, j, h))[1]
                t += step
                f = f + step[c[:, i], c[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.prior)
        if self.tables:
            b = self._binned(x)
            for j, t in enumerate(self.tables):
                f += t[b[:, j]]
            for i, j, ci, cj, t in self.two:
                f += t[ci[b[:, i]], cj[b[:, j]]]
        return 1 / (1 + np.exp(-f))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<float>) of each whole text."""
    def run(batches):
        for b in fl.slices(batches):
            x = features(Signals(b.column("text")))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], ["doc_id", "features"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, features array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 3, held: int = 1, sample: int = SAMPLE) -> Gam:
    """Fit on about ``sample`` labelled documents outside the held-out fold.
    The sampled labels are broadcast: their number is bounded by ``sample``."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("_y is not null and doc_id is not null")
             .where(crc_remainder(F.col("doc_id"), fold) != held).groupBy("doc_id").agg(F.max("_y").alias("_y")))
    share = min(1.0, sample / max(known.count(), 1))
    known = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000)))
    found = extract(docs.select("doc_id", "text").join(known, "doc_id", "left_semi")).dropDuplicates(["doc_id"])
    rows = found.join(known, "doc_id").select("features", "_y").toArrow().combine_chunks()
    x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)  # rows arrive in any order; the fit shouldn't depend on it
    y = rows.column("_y").to_numpy() if len(x) else np.zeros(0)
    return Gam().fit(x[order], (y[order] > 0).astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text."""
    model = train(docs, labels, fold=fold, held=held)

    def run(batches):
        for b in fl.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(Signals(b.column("text")))))], ["doc_id", "score"])

    src = docs.select("doc_id", "text")
    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns, of the documents the model does not reject."""
    model = train(docs, labels)

    def run(batches):
        for b in fl.slices(batches):
            yield b.filter(pa.array(model.score(features(Signals(b.column("text")))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
