"""Toxicity: subword bags averaged into a linear softmax.

A word (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) is the mean of the vectors
of its subwords: the word itself and the byte 3-, 4- and 5-grams inside it
with a border on each side, hashed into BUCKETS rows.  A text is the mean of
its words, and a linear softmax over it gives the two classes.  Vectors and
softmax are trained jointly in numpy by AdaGrad; a misspelling that was never
seen still shares most of its n-grams with the words that were.  Only buckets
whose presence tells the classes apart in the sample (``telling``) get a
vector, the others stay zero: one insult among hundreds of words is a small
part of the mean, which the noise of thousands of idle vectors would drown.

Training rows are a bounded sample of the labelled documents outside the
held-out fold: at most about SAMPLE documents and SAMPLE_BYTES bytes of whole
texts, up to half of them toxic, chosen by a hash of id and text.  A fifth of
them is kept from training; on it a slope and an offset are fitted with both
classes weighted alike, so that a score of 0.5 errs as little on toxic texts
as on others.

Vectors times softmax weights are one number a bucket after training; a
document costs one gather and running sums.

Defined results: a text without a word (null, empty, white space) has score
0; without training rows, or with one class only, every score is that class
(0 without any).  A document's label is the largest of its rows in ``labels``;
null labels and ids are left out.  Rows that share an id are training rows of
their own and all are scored.  A null id counts as '' for the fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import flat as fl
from tracefold.llm.common import crc_remainder

BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4, 5)
SAMPLE, SAMPLE_BYTES = 8_000, 16 << 20
LEAST_Z, KEPT = 5.0, 2048
_M = np.uint64


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run, the same to the last bit wherever the run lies."""
    out, some = np.zeros(len(off) - 1), np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(x, off[:-1][some])
    return out


class Subwords:
    """Subwords of all words of a slice: ``parts`` holds (buckets, offsets by
    word) of the words themselves and of each n-gram length."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        starts, ends, self.woff, wh = fl.words(buf, off, lower=True)
        self.words = len(starts)
        self.parts = [((wh % _M(BUCKETS)).astype(np.int64), np.arange(self.words + 1))]
        size = ends - starts + 2
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        letters = np.full(at[-1], 32, np.uint64)             # words with a border before and after each
        inner = np.ones(at[-1], bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        letters[inner] = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)[fl.IS_WORD[buf]]
        for n in GRAMS:
            code = np.zeros(max(at[-1] - n + 1, 0), np.uint64)
            for j in range(n):
                code = code << _M(8) | letters[j: j + len(code)]
            count = np.maximum(size - n + 1, 0)
            first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
            here = np.repeat(at[:-1] - first[:-1], count) + np.arange(first[-1])
            self.parts.append(((fl.mix(code[here] + _M(n << 56)) % _M(BUCKETS)).astype(np.int64), first))
        self.size = sum(np.diff(first) for _, first in self.parts)  # subwords of each word

    def bags(self):
        """(buckets, weights that sum to 1) of each document."""
        n_words = np.diff(self.woff)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        share = 1 / (self.size * np.maximum(n_words, 1)[doc])
        out = []
        for a, z in zip(self.woff[:-1].tolist(), self.woff[1:].tolist()):
            ids = [b[first[a]: first[z]] for b, first in self.parts]
            w = [np.repeat(share[a:z], np.diff(first[a: z + 1])) for _, first in self.parts]
            u, back = np.unique(np.concatenate(ids), return_inverse=True)
            out.append((u.astype(np.int32), np.bincount(back, np.concatenate(w), len(u)).astype(np.float32)))
        return out

    def means(self, value: np.ndarray) -> np.ndarray:
        """Each document's mean of its words' means of value[subword]."""
        total = np.zeros(self.words)
        for b, first in self.parts:
            total += sums(value[b], first)
        return sums(total / np.maximum(self.size, 1), self.woff) / np.maximum(np.diff(self.woff), 1)


def telling(bags: list, y: np.ndarray, least: float = LEAST_Z, most: int = KEPT) -> np.ndarray:
    """Buckets found in clearly more (or fewer) texts of one class than of the
    other: two-proportion z of ``least`` at least, the strongest ``most``."""
    found = np.zeros((2, BUCKETS))
    for (f, _), c in zip(bags, y):
        found[int(c), f] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    p = found.sum(0) / n.sum()
    z = np.abs(found[1] / n[1] - found[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= least]) if (z >= least).any() else np.sort(best[:64])


class Model:
    def __init__(self):
        self.value, self.bias, self.slope, self.offset, self.constant = np.zeros(BUCKETS), 0.0, 1.0, 0.0, 0.0

    def fit(self, bags: list, y: np.ndarray, epochs: int = 30, rate: float = 0.3, batch: int = 64, seed: int = 12) -> "Model":
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.0
            return self
        self.constant = None
        kept = telling(bags, y)
        x = np.zeros((len(y), len(kept)), np.float32)
        column = np.full(BUCKETS, -1)
        column[kept] = np.arange(len(kept))
        for i, (f, w) in enumerate(bags):
            c = column[f]
            x[i, c[c >= 0]] = w[c >= 0]
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.1, (len(kept), WIDTH)).astype(np.float32), "out": rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32), "bias": np.zeros(2, np.float32)}
        seen = {k: np.full((len(kept), 1) if k == "emb" else v.shape, 1e-10, np.float32) for k, v in p.items()}
        order = rng.permutation(len(y))
        held, use = (order[: len(y) // 5], order[len(y) // 5:]) if len(y) >= 50 else (order, order)
        pull = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)  # both classes pull alike
        for _ in range(epochs):
            deal = rng.permutation(use)
            for a in range(0, len(deal), batch):
                i = deal[a: a + batch]
                mean = x[i] @ p["emb"]
                z = mean @ p["out"] + p["bias"]
                e = np.exp(z - z.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                e[np.arange(len(i)), y[i].astype(int)] -= 1
                e *= pull[i][:, None] / len(i)
                for k, g in (("emb", x[i].T @ (e @ p["out"].T)), ("out", mean.T @ e), ("bias", e.sum(0))):
                    seen[k] += (g * g).mean(1, keepdims=True) if k == "emb" else g * g
                    p[k] -= rate * g / np.sqrt(seen[k])
        side = p["out"][:, 1] - p["out"][:, 0]
        self.value[kept] = p["emb"] @ side
        self.bias = float(p["bias"][1] - p["bias"][0])
        raw = x[held].astype(np.float64) @ self.value[kept] + self.bias
        self._calibrate(raw, y[held], pull[held])
        return self

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Slope and offset by weighted logistic regression (ridge of 1e-3)."""
        if len(y) == 0 or y.min() == y.max():
            return
        spread = float(raw.std()) or 1.0
        x = np.stack([raw / spread, np.ones(len(raw))], 1)
        t, w = np.array([spread, 0.0]), weight / weight.sum()
        loss = lambda t: float((w * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ t))).sum() + 5e-4 * (t @ t))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ t, -60, 60)))
            grad = x.T @ (w * (p - y)) + 1e-3 * t
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
            size = 1.0
            while size > 1e-6 and loss(t - size * step) > loss(t):
                size /= 2
            t = t - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        self.slope, self.offset = float(t[0] / spread), float(t[1])

    def scores(self, s: Subwords) -> np.ndarray:
        some = np.diff(s.woff) > 0
        if self.constant is not None:
            return np.where(some, self.constant, 0.0)
        z = (s.means(self.value) + self.bias) * self.slope + self.offset
        return np.where(some, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample.  Tasks send bags of hashed subwords, not texts;
    the sample's ids are broadcast (at most about ``sample`` rows)."""
    known = (labels.select("doc_id", (F.col(label) > 0).cast("int").alias("_y")).where("_y is not null and doc_id is not null")
             .where(crc_remainder(F.col("doc_id"), fold) != held).groupBy("doc_id").agg(F.max("_y").alias("_y")))
    count = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}  # two rows
    if not count:
        return Model()
    total = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    want = min(sample, sample_bytes / max(total, 1.0))
    share = {y: min(1.0, want / len(count) / n) for y, n in count.items()}
    part = lambda c: F.pmod(F.xxhash64(*c, F.lit(12)), F.lit(1_000_000))
    limit = F.when(F.col("_y") == 1, round(share.get(1, 0) * 1e6)).otherwise(round(share.get(0, 0) * 1e6))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.where(part(["doc_id"]) < limit)), "doc_id")

    def run(batches):
        for b in fl.slices(batches):
            bags = Subwords(*fl.flat(b.column("text"))).bags()
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array([u.tobytes() for u, _ in bags], pa.binary()), pa.array([w.tobytes() for _, w in bags], pa.binary())],
                                             ["y", "ids", "w"])

    rows = chosen.select("text", "_y").mapInArrow(run, "y int, ids binary, w binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["ids"]), key=lambda r: (r["y"], r["ids"], r["w"]))  # any order of arrival gives one model
    y = np.array([r["y"] for r in rows], np.float64)
    return Model().fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["w"], np.float32)) for r in rows], y)


def score(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text."""
    model = model or train(docs, labels, fold=fold, held=held)

    def run(batches):
        for b in fl.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(Subwords(*fl.flat(b.column("text")))))], ["doc_id", "score"])

    src = docs.select("doc_id", "text")
    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
