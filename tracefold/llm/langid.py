"""Language identification by averaged hashed subword embeddings.

A text's features are its words and the byte 3- and 4-grams inside its words
(with their borders), hashed into BUCKETS rows.  Their embeddings are
averaged, and a linear softmax gives the languages; both are trained
together by stochastic gradient descent in numpy on a bounded sample
(SAMPLE documents by hash) of the rows that are not held out.  As the model
is linear after the average, embedding times output weights is one score
table, and a document is scored by one gather and one segment sum.

Part of the sample is kept from training to fit the temperature of the
softmax and the rejection threshold: the score under which the answer is
marked ``rejected`` is set so that ERROR of the accepted calibration answers
are wrong at most.  The answer itself stays a learned language.

Defined results: a text that is null or holds no letter is ``und`` with
score 0; without any training row every text is ``und`` with score 0; a null
id counts as '' for the fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import flat as fl
from tracefold.llm.common import crc_remainder

BUCKETS, WIDTH, SAMPLE, ERROR = 1 << 15, 16, 6_000, 0.01

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each document, and the documents' offsets."""
    starts, ends, woff, wh = fl.words(buf, off, lower=True)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    # words with a border before and after each: one flat array of letters
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    letters = np.full(at[-1], 32, np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    letters[inner] = low[fl.IS_WORD[buf]]
    parts, weights = [wh % np.uint64(BUCKETS)], [woff]
    for n, seed in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        g = np.zeros(max(at[-1] - n + 1, 0), np.uint64)
        for j in range(n):
            g = g * np.uint64(257) + letters[j: j + len(g)]
        count = np.maximum(size - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        pos = np.repeat(at[:-1] - first[:-1], count) + np.arange(first[-1])
        g = g[pos] * np.uint64(seed)
        parts.append((g ^ (g >> np.uint64(15))) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(40))
        weights.append(first[woff])
    # one run per document: words, then 3-grams, then 4-grams
    total = sum(np.diff(w) for w in weights)
    out_off = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(out_off[-1], np.int64)
    base = out_off[:-1].copy()
    for p, w in zip(parts, weights):
        n = np.diff(w)
        out[np.repeat(base - w[:-1], n) + np.arange(w[-1])] = (p % np.uint64(BUCKETS)).astype(np.int64)
        base = base + n
    return out, out_off


def has_letter(col: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    out = c[off[1:]] > c[off[:-1]]
    for i in np.flatnonzero(~out).tolist():  # only texts without an ASCII letter
        t = col[i].as_py()
        out[i] = bool(t) and any(map(str.isalpha, t))
    return out


class Model:
    def __init__(self, names: list[str]):
        self.names, self.table = names, np.zeros((BUCKETS, len(names)), np.float32)
        self.bias, self.heat, self.threshold = np.zeros(len(names)), 1.0, 0.0

    def fit(self, bags: list, y: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> "Model":
        """bags: (buckets, weights summing to 1) of each document."""
        rng = np.random.default_rng(seed)
        k = len(self.names)
        emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        out, bias = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
        order = rng.permutation(len(bags))
        held, use = order[: len(order) // 5], order[len(order) // 5:]
        use = use if len(use) else order
        for epoch in range(epochs):
            for i in rng.permutation(use).tolist():
                f, w = bags[i]
                mean = w @ emb[f]
                z = mean @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                step = rate * (1 - epoch / epochs)
                back = out @ p
                out -= step * np.outer(mean, p)
                bias -= step * p
                emb[f] -= step * w[:, None] * back * min(len(f), 64)  # larger texts spread their gradient thin
        self.table, self.bias = (emb @ out).astype(np.float32), bias.astype(np.float64)
        if len(held):
            z = np.stack([bags[i][1] @ self.table[bags[i][0]] for i in held.tolist()]) + self.bias
            t = y[held]
            loss = {h: self._loss(z * h, t) for h in 2.0 ** np.arange(-3, 5)}
            self.heat = float(min(loss, key=loss.get))
            p = self._softmax(z * self.heat)
            top, ok = p.max(1), p.argmax(1) == t
            rank = np.argsort(-top)
            good = np.cumsum(~ok[rank]) <= ERROR * np.arange(1, len(rank) + 1)
            self.threshold = float(top[rank][np.flatnonzero(good)[-1]]) if good.any() else 1.0
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def _loss(self, z: np.ndarray, t: np.ndarray) -> float:
        return float(-np.log(self._softmax(z)[np.arange(len(t)), t] + 1e-12).mean())

    def scores(self, f: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities of each document."""
        n = np.diff(off)
        z = np.zeros((len(n), len(self.names)))
        some = n > 0
        if some.any():
            for j in range(len(self.names)):
                z[some, j] = np.add.reduceat(self.table[:, j][f], off[:-1][some], dtype=np.float64) / n[some]
        return self._softmax((z + self.bias) * self.heat)


def train(docs: DataFrame, fold: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` documents with a language outside the held-out
    fold.  Tasks send bags of hashed features, not texts."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null").where(crc_remainder(F.col("doc_id"), fold) != held)
    langs = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    share = F.lit(1.0)
    for name, n in langs.items():  # an equal part for each language
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / len(langs) / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches):
        for b in fl.slices(batches):
            f, off = subwords(*fl.flat(b.column("text")))
            ids, n = [], []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                u, c = np.unique(f[a:z], return_counts=True)
                ids.append(u.astype("<u2").tobytes())
                n.append(c.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(ids, pa.binary()), pa.array(n, pa.binary())], ["lang", "ids", "n"])

    rows = chosen.mapInArrow(run, "lang string, ids binary, n binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["ids"]), key=lambda r: (r["lang"], r["ids"], r["n"]))
    names = sorted({r["lang"] for r in rows})
    bags = [(np.frombuffer(r["ids"], "<u2").astype(np.int64), (lambda c: c / c.sum())(np.frombuffer(r["n"], "<f4"))) for r in rows]
    model = Model(names)
    return model.fit(bags, np.array([names.index(r["lang"]) for r in rows])) if rows else model


def identify(docs: DataFrame, model: Model | None = None, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each whole text."""
    model = model or train(docs, fold, held)

    def run(batches):
        names = pa.array([*model.names, "und"], pa.string())
        for b in fl.slices(batches):
            col = b.column("text")
            buf, off = fl.flat(col)
            ok = has_letter(col, buf, off) & bool(model.names)
            best, top = np.full(len(ok), len(model.names)), np.zeros(len(ok))
            if model.names:
                p = model.scores(*subwords(buf, off))
                best, top = np.where(ok, p.argmax(1), best), np.where(ok, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names.take(pa.array(best)), pa.array(top), pa.array(~ok | (top < model.threshold))],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    src = docs.select("doc_id", "text")
    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), fold) == held).alias("held_out"), "lang_pred", "score", "rejected")
