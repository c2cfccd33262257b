"""Language-model scores: a smoothed word-unigram base and a causal
self-attention model on subword ids, trained in numpy.

Corpus statistics.  Every chunk (below) counts its distinct words; the counts
meet by the word's hash, and each distinct word is cut into subword ids once.  So
counts, vocabulary and subword frequencies cover all training documents, and
what is gathered grows with the corpus.

Encoding.  Documents are dealt into chunks of about CHUNK_BYTES.  The counts
and ids of a word go to the chunks that have it (no join, no broadcast), and
a chunk is encoded as a whole against this lexicon without a Python loop over
words.  Ids and base scores are stored; the model is fitted and
applied on them.

Model.  p(id | before) = p(class | before) * p(id | class).  Classes are
clusters of ids with alike neighbours, which are counted in all training
documents; p(id | class) comes from the corpus-wide subword counts.  p(class | before) is a one-layer causal
attention model over windows of WINDOW ids.  Windows overlap: each later one
repeats OVERLAP ids as context only, so every id is scored exactly once, with
batched masked attention.  Weights start from a bounded sample of windows
(SAMPLE, from documents chosen by hash).  From there as many local runs as
there are chunks go on with all windows of training ids, dealt by hash, each
window in one of them, and the mean of what they have changed is taken, so all
training text is learned from and its layout doesn't matter.

Defined results: a null or empty text is its end token alone; a null id
counts as '' for the fold; without training rows N and V are 0, so the base
score is 0 and the model knows only its uniform start.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import bpe
from tracefold.llm import flat as fl
from tracefold.llm.common import crc_remainder, stored

CHUNK_BYTES, CHUNKS_LEAST = 20 << 20, 24
LEXICON_ROWS = 10_000
WINDOW, OVERLAP, WIDTH, CLASSES, LIMIT = 32, 8, 16, 64, 30.0
SAMPLE, PER_DOC = 24_000, 64
HEADS, BATCH, PART, PIECE = 256, 64, 4096, 64
IDS_BYTES = 1 << 20


# -- corpus statistics -------------------------------------------------------
class _Words:
    """Distinct words with counts, until they are sent."""

    def __init__(self):
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)   # sorted
        self.found: list[np.ndarray] = []
        self.text: list[pa.Array] = []

    def add(self, buf, starts, ends, wh, weight) -> None:
        u, first, back = np.unique(wh, return_index=True, return_inverse=True)
        n = np.bincount(back, weight, len(u)).astype(np.int64)
        at = np.searchsorted(self.h, u)
        known = np.zeros(len(u), bool)
        known[at < len(self.h)] = self.h[at[at < len(self.h)]] == u[at < len(self.h)]
        self.n[at[known]] += n[known]
        new = ~known
        s, e = starts[first[new]], ends[first[new]]
        size = e - s
        off = np.concatenate([[0], np.cumsum(size)])
        letters = buf[np.repeat(s - off[:-1], size) + np.arange(off[-1])]
        letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
        self.text.append(pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())]))
        self.found.append(u[new])
        self.h = np.insert(self.h, at[new], u[new])
        self.n = np.insert(self.n, at[new], n[new])

    def batches(self):
        if self.found:
            h = np.concatenate(self.found)
            t = pa.table({"h": pa.array(h.view(np.int64)), "word": pa.chunked_array(self.text).cast(pa.string()), "n": pa.array(self.n[np.searchsorted(self.h, h)])})
            yield from t.to_batches(max_chunksize=100_000)
        self.__init__()


def word_counts(dealt: DataFrame) -> DataFrame:
    """(chunk, h, word, n): every distinct word of a chunk with its count in the
    chunk's training documents."""
    def run(t: pa.Table) -> pa.Table:
        words, chunk = _Words(), t.column("chunk")[0]
        for b in fl.slices(t.to_batches()):
            buf, off = fl.flat(b.column("text"))
            starts, ends, woff, wh = fl.words(buf, off, lower=True)
            use = np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), np.diff(woff))
            words.add(buf, starts, ends, wh, use.astype(np.float64))
        out = pa.Table.from_batches(words.batches(), pa.schema([("h", pa.int64()), ("word", pa.string()), ("n", pa.int64())]))
        return out.add_column(0, "chunk", pa.repeat(chunk, len(out)))

    return dealt.groupBy("chunk").applyInArrow(run, "chunk long, h long, word string, n long")


def lexicon(counts: DataFrame, shared, parts: int) -> DataFrame:
    """(h, c, ids binary, chunks), stored: count and subword ids of each word of
    the corpus and the chunks that have it.  A word's rows meet in one of ``parts``
    tasks, as many as there are chunks, so a task holds as much as a chunk has."""
    def run(batches):
        enc = shared.value
        t = pa.Table.from_batches(batches, pa.schema([("chunk", pa.int64()), ("h", pa.int64()), ("word", pa.string()), ("n", pa.int64())]))
        h = t.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.append(len(h) > 0, h[1:] != h[:-1])[: len(h)])
        c, chunk = (t.column(x).to_numpy()[order] for x in ("n", "chunk"))
        c = np.add.reduceat(c, first) if len(first) else c
        word, to = t.column("word").take(pa.array(order[first])), np.append(first, len(h))
        for k in range(0, len(first), LEXICON_ROWS):
            enc.forget()  # each word comes once
            m = min(k + LEXICON_ROWS, len(first))
            where = pa.ListArray.from_arrays(pa.array((to[k: m + 1] - to[k]).astype(np.int32)), pa.array(chunk[to[k]: to[m]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[first[k:m]]), pa.array(c[k:m]), pa.array(enc.encode_bytes(word[k:m].to_pylist()), pa.binary()), where], ["h", "c", "ids", "chunks"])

    return stored(counts.repartition(parts, "h").mapInArrow(run, "h long, c long, ids binary, chunks array<long>"), "lm-lexicon")


def subword_counts(words: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the training documents (a row per id)."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            data = b.column("ids").to_pylist()
            total += np.bincount(np.frombuffer(b"".join(data), "<u4"), np.repeat(b.column("c").to_numpy(), [len(x) // 4 for x in data]), size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in words.where("c > 0").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


# -- the model ---------------------------------------------------------------
def id_type(size: int) -> str:
    """How stored ids are written; the end id is the size."""
    return "<u2" if size < 1 << 16 else "<u4"


def stored_ids(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document offsets) of a column of stored ids."""
    buf, off = fl.flat(col)
    kind = np.dtype(id_type(size))
    return buf.view(kind).astype(np.int64), off // kind.itemsize


def neighbours(encoded: DataFrame, heads: np.ndarray, size: int) -> np.ndarray:
    """How often each id has each of the heads after it (first HEADS columns)
    and before it, in all training documents."""
    wide = 2 * HEADS
    slot = np.full(size + 1, -1, np.int32)
    slot[heads] = np.arange(len(heads))

    def run(batches):
        total = np.zeros(size * wide, np.int32)
        for b in fl.slices(batches, "ids", IDS_BYTES):
            ids = stored_ids(b.column("ids"), size)[0].astype(np.int32)
            head, word = slot[ids], ids < size
            m = np.flatnonzero((head[1:] >= 0) & word[:-1])
            after = ids[m] * np.int32(wide) + head[m + 1]
            m = np.flatnonzero((head[:-1] >= 0) & word[1:])
            before = ids[m + 1] * np.int32(wide) + np.int32(HEADS) + head[m]
            np.add.at(total, np.concatenate([after, before]).astype(np.intp), np.int32(1))
        some = np.flatnonzero(total)
        yield from pa.table({"key": pa.array(some), "n": pa.array(total[some].astype(np.int64))}).to_batches(max_chunksize=100_000)

    out = np.zeros(size * wide, np.float32)
    pairs = encoded.where("not held_out").select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for b in pairs.select(F.col("key").cast("int"), F.col("n").cast("float")).toArrow().to_batches():
        out[b.column("key").to_numpy()] = b.column("n").to_numpy()
    return out.reshape(size, wide)


def cluster(counts: np.ndarray, profile: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each id: k-means of the neighbour counts; only ids that have
    no neighbour among the heads share the last class."""
    k = classes - 1
    out = np.full(len(counts), classes - 1)
    np.sqrt(profile, out=profile)
    weight = np.sqrt(np.einsum("ij,ij->i", profile, profile))
    ids = np.flatnonzero(weight[: len(profile)] > 0)
    ids = ids[np.argsort(-counts[ids], kind="stable")]
    if len(ids) <= k:
        out[ids] = np.arange(len(ids))
        return out
    weight = weight[ids]
    profile = profile[ids]
    profile /= weight[:, None]
    centre = profile[:k].copy()  # the most frequent ids
    for _ in range(12):
        best = (profile @ centre.T).argmax(1)
        for j in range(k):
            if (best == j).any():
                centre[j] = weight[best == j] @ profile[best == j]
                centre[j] /= max(np.linalg.norm(centre[j]), 1e-6)
    out[ids] = best
    return out


class Attention:
    """One causal attention layer with a residual, classes as output."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = WIDTH
        self.end, self.begin, self.size = size, size + 1, size
        g = lambda *s, by=1.0: (rng.normal(0, by, s)).astype(np.float32)
        self.p = {"emb": g(size + 2, d, by=0.1), "pos": g(WINDOW, d, by=0.1), "qkv": g(d, 3 * d, by=d**-0.5), "out": g(d, d, by=d**-0.5),
                  "top": g(d, CLASSES, by=d**-0.5), "bias": np.zeros(CLASSES, np.float32)}
        self.mask = np.tri(WINDOW, dtype=np.float32)
        self.of = np.full(size + 1, CLASSES - 1)
        self.inside = np.full(size + 1, -np.log10(size + 1.0))

    def know(self, counts: np.ndarray, ends: int, profile: np.ndarray) -> "Attention":
        """Classes and p(id | class) from corpus-wide counts, add-one."""
        counts = np.append(counts, ends)
        self.of = cluster(counts, profile)
        n = counts + 1.0
        total = np.bincount(self.of, n, CLASSES)
        self.inside = np.log10(n / total[self.of])
        first = np.maximum(np.bincount(self.of, counts, CLASSES), 0.5)
        self.p["bias"] = np.log(first / first.sum()).astype(np.float32)
        return self

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights as they are used: the root of WIDTH goes into those of the
        queries, the bias is a last row of ``top``."""
        qkv = self.p["qkv"].copy()
        qkv[:, :WIDTH] *= WIDTH**-0.5
        return qkv, np.concatenate([self.p["top"], self.p["bias"][None]])

    def _attend(self, t: np.ndarray, new: int = 0):
        """t: queries, keys, values and a one for each place of the windows; the
        ones sum the weights.  Scores are held within LIMIT, so their exponentials
        need no maximum; attention to later ids is multiplied away.  Queries begin
        at place ``new``."""
        d, w = WIDTH, t.shape[1]
        q, k, v = t[:, new:, :d], t[..., d: 2 * d], t[..., 2 * d: 3 * d + 1]
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(s, -LIMIT, LIMIT, out=s)
        np.exp(s, out=s)
        s *= self.mask[new:w, :w]
        return q, k, v, s, np.matmul(s, v)

    def _forward(self, x: np.ndarray, w: int, new: int = 0, weights=None):
        """Logits are held within LIMIT, too; they begin at place ``new``."""
        p, d = self.p, WIDTH
        qkv, top = weights or self._weights()
        e = p["emb"].take(x, 0)
        e += p["pos"][:w]
        t = np.empty((len(x), w, 3 * d + 1), e.dtype)
        np.matmul(e.reshape(-1, d), qkv, out=t.reshape(-1, 3 * d + 1)[:, :-1])
        t[..., -1] = 1
        q, k, v, s, o = self._attend(t, new)
        total = o[..., d:]
        o = o[..., :d] / total
        h = np.ones((*o.shape[:2], d + 1), o.dtype)
        np.add((o.reshape(-1, d) @ p["out"]).reshape(o.shape), e[:, new:], out=h[..., :d])
        z = h.reshape(-1, d + 1) @ top
        np.clip(z, -LIMIT, LIMIT, out=z)
        return e, q, k, v, s, total, o, h, z

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For scoring, where weights stay: what each id and each place adds to
        queries, keys, values (through ``out``), the one, h and its one."""
        p, d = self.p, WIDTH
        qkv, top = self._weights()
        qkv[:, 2 * d:] = qkv[:, 2 * d:] @ p["out"]
        of_id, of_place = (np.zeros((len(p[k]), 4 * d + 2), p[k].dtype) for k in ("emb", "pos"))
        for t, k in ((of_id, "emb"), (of_place, "pos")):
            np.matmul(p[k], qkv, out=t[:, : 3 * d])
            t[:, 3 * d + 1: -1] = p[k]
        of_id[:, 3 * d] = 1
        return of_id, of_place, top

    @staticmethod
    def _log_share(z: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """log softmax of each row at its goal; z is used up."""
        at = z[np.arange(len(z)), goal]
        return at - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))

    def _state(self) -> list:
        """Weights with Adam's two means: all but the embeddings, made views of one
        array, and the embeddings; then a place for each id, for distinct()."""
        names = [k for k in self.p if k != "emb"]
        line = np.concatenate([self.p[k].ravel() for k in names])
        at = np.cumsum([0, *(self.p[k].size for k in names)]).tolist()
        self.p.update({k: line[a:b].reshape(self.p[k].shape) for k, a, b in zip(names, at, at[1:])})
        return [*((v, np.zeros_like(v), np.zeros_like(v)) for v in (line, self.p["emb"])), np.zeros(self.size + 2, np.intp)]

    def fit(self, windows: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 7) -> "Attention":
        """windows: rows of WINDOW + 1 ids (begin, then the text; padded by -1)."""
        if not len(windows):
            return self
        rng = np.random.default_rng(seed)
        state = self._state()
        for step in range(1, steps + 1):
            self.learn(windows[rng.integers(0, len(windows), batch)], state, step, rate * min(1.0, 2 * (1 - step / (steps + 1))))
        return self

    def learn(self, rows: np.ndarray, state: list, step: int, now: float, sparse: bool = False) -> None:
        """One step of Adam; ``state`` is _state().  ``sparse``: of the embeddings
        only the rows of this step's ids move, so a step costs what it reads."""
        p, d = self.p, WIDTH
        x, goal = np.where(rows[:, :-1] < 0, self.end, rows[:, :-1]), rows[:, 1:].ravel()
        qkv, top = self._weights()
        e, q, k, v, s, total, o, h, z = self._forward(x, WINDOW, weights=(qkv, top))
        flat = lambda a: a.reshape(-1, a.shape[-1])
        # a row's factors (softmax, attention's weights) go into the narrow side of each product
        y = np.exp(z, out=z)
        whole = y @ np.ones(y.shape[1], y.dtype)
        real = goal >= 0
        share = real.astype(y.dtype) / (max(int(real.sum()), 1) * whole)  # a padded place counts nothing
        np.subtract.at(y.reshape(-1), np.arange(0, y.size, y.shape[1]) + self.of[goal], whole)
        dh = y @ p["top"].T
        dh *= share[:, None]
        h = flat(h)
        h *= share[:, None]
        g_top = (y.T @ h).T  # the bias is its last row
        g_out = flat(o).T @ dh
        do = np.empty((*x.shape, d + 1), y.dtype)
        np.divide((dh @ p["out"].T).reshape(o.shape), total, out=do[..., :d])
        np.negative(np.einsum("ijk,ijk->ij", do[..., :d], o), out=do[..., d])  # the mean of a row of ds by its weights
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds *= s
        dqkv = np.empty((*x.shape, 3 * d), y.dtype)
        np.matmul(ds, k, out=dqkv[..., :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., d: 2 * d])
        np.matmul(s.transpose(0, 2, 1), do[..., :d], out=dqkv[..., 2 * d:])
        g_qkv = (flat(dqkv).T @ flat(e)).T
        g_qkv[:, :d] *= d**-0.5
        de = flat(dqkv) @ qkv.T
        de += dh
        g = {"pos": de.reshape(x.shape[0], -1).sum(0), "qkv": g_qkv, "out": g_out, "top": g_top[:-1], "bias": g_top[-1]}
        ids = x.ravel()
        rows_of, place = distinct(ids, state[-1]) if sparse else (None, ids)
        # added two at a time, as complex numbers
        pairs = np.result_type(de, np.complex64)
        g_emb = np.zeros((len(rows_of) if sparse else len(p["emb"])) * d // 2, pairs)
        np.add.at(g_emb, (place[:, None] * (d // 2) + np.arange(d // 2)).ravel(), de.view(pairs).ravel())
        g_emb = g_emb.view(de.dtype)
        fade, far = now / (1 - 0.9**step), 1 / (1 - 0.99**step)
        for held, grad in zip(state, (np.concatenate([g[k].ravel() for k in p if k != "emb"]), g_emb.reshape(-1, d))):
            some = sparse and grad.ndim == 2
            value, mean, square = (a.take(rows_of, 0) if some else a for a in held)
            mean *= 0.9
            mean += 0.1 * grad
            grad *= grad
            grad *= 0.01
            square *= 0.99
            square += grad
            np.sqrt(square * far, out=grad)
            grad += 1e-8
            np.divide(mean, grad, out=grad)
            grad *= fade
            value -= grad
            if some:
                for a, new in zip(held, (value, mean, square)):
                    a[rows_of] = new

    def go_on(self, batches, rate: float = 0.001) -> np.ndarray:
        """Learn from batches of windows; the changes by weight, each times
        how often its id (or any id) was seen, and these numbers."""
        old = {k: v.copy() for k, v in self.p.items()}
        state = self._state()
        seen, read = np.zeros(self.size + 2), []
        for step, rows in enumerate(batches, 1):
            self.learn(rows, state, step, rate, sparse=True)
            read.append(rows[:, :-1].ravel())
            if step % 64 == 0:
                seen += np.bincount(np.concatenate(read) + 1, minlength=len(seen) + 1)[1:]  # padding is -1
                read = []
        if read:
            seen += np.bincount(np.concatenate(read) + 1, minlength=len(seen) + 1)[1:]
        n = seen.sum()
        change = [((self.p[k] - old[k]) * (seen[:, None] if k == "emb" else n)).ravel() for k in sorted(old)]
        return np.concatenate([*change, seen])

    def take(self, total: np.ndarray) -> "Attention":
        """Apply the sums of the tasks' go_on()."""
        seen, at = total[-(self.size + 2):], 0
        for k in sorted(self.p):
            v = self.p[k]
            change = total[at: at + v.size].reshape(v.shape)
            v += (change / np.maximum(seen[:, None] if k == "emb" else seen.sum(), 1)).astype(v.dtype)
            at += v.size
        return self

    def score(self, ids: np.ndarray, off: np.ndarray, batch: int = 128) -> np.ndarray:
        """log10 probability of each text; ids hold each text's end id."""
        n = np.diff(off)
        step, d = WINDOW - OVERLAP, WIDTH
        count = np.where(n > 0, 1 + np.maximum(-(-(n - WINDOW) // step), 0), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(n)), count)
        start = (np.arange(first[-1]) - first[doc]) * step
        total = np.add.reduceat(np.append(self.inside[ids], 0.0), off[:-1]) * (n > 0) if len(n) else np.zeros(0)
        before = np.append(ids, self.end)
        of, (of_id, of_place, top) = self.of[before], self._tables()
        wide_of, later = np.minimum(n[doc] - start, WINDOW), start > 0
        start += off[doc]
        order = np.argsort(wide_of + 2 * WINDOW * later, kind="stable")  # short windows together, first ones before later ones
        firsts = int(len(order) - later.sum())
        share = np.zeros(len(order))
        for a in [*range(0, firsts, batch), *range(firsts, len(order), batch)]:
            w = order[a: min(a + batch, firsts) if a < firsts else a + batch]
            wide, new = int(wide_of[w[-1]]), 0 if a < firsts else OVERLAP
            at = start[w, None] + np.arange(wide)
            full = wide_of[w[0]] == wide
            if not full:
                real = np.arange(wide) < wide_of[w, None]
                at = np.where(real, at, len(ids))
            x = before[at - 1]
            if not new:
                x[:, 0] = self.begin
            t = of_id.take(x, 0)
            t += of_place[:wide]
            h = self._attend(t, new)[-1]
            h /= h[..., d:].copy()  # its last place, the sum of the weights, becomes the bias's one
            h += t[:, new:, 3 * d + 1:]
            z = h.reshape(-1, d + 1) @ top
            np.clip(z, -LIMIT, LIMIT, out=z)
            logp = self._log_share(z, of[at[:, new:]].ravel()).reshape(len(w), -1)
            share[w] = (logp if full else logp * real[:, new:]).sum(1)
        return total + np.bincount(doc, share / np.log(10), len(n))


def distinct(ids: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and each id's place among them; slot has room for every id
    and needs no clearing."""
    number = np.arange(len(ids))
    slot[ids] = number  # one of an id's places stays
    some = ids[slot[ids] == number]
    slot[some] = number[: len(some)]
    return some, slot[ids]


def windows_of(ids: np.ndarray, begin: int, chosen=None) -> np.ndarray:
    """Windows of WINDOW + 1 ids of a text with its end id; chosen picks among
    their starts."""
    line = np.concatenate([[begin], ids])
    starts = np.arange(0, len(line) - 1, WINDOW)
    starts = starts if chosen is None else chosen(starts)
    line = np.concatenate([line, np.full(WINDOW + 1, -1)])
    return line[starts[:, None] + np.arange(WINDOW + 1)]


def windows_in(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every window of pieces that begin with the id before
    their first; windows overlap by that one id."""
    count = -(-(np.diff(off) - 1) // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    piece = np.repeat(np.arange(len(count)), count)
    start = off[piece] + (np.arange(first[-1]) - first[piece]) * WINDOW
    return start, np.minimum(start + WINDOW + 1, off[piece + 1])


def first_windows(encoded: DataFrame, size: int, tokens: int, sample: int) -> np.ndarray:
    """About ``sample`` windows of training documents, PER_DOC of one at most."""
    share = min(1.0, sample * WINDOW / max(tokens, 1))
    chosen = encoded.where("not held_out").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < max(round(share * 1_000_000), 1))

    def run(batches):
        for b in fl.slices(batches, "ids", IDS_BYTES):
            ids, off = stored_ids(b.column("ids"), size)
            for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
                rng = np.random.default_rng(y - x)
                w = windows_of(ids[x:y], size + 1, lambda s: s if len(s) <= PER_DOC else np.sort(rng.choice(s, PER_DOC, replace=False)))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in w.astype(np.int32)], pa.binary())], ["w"])

    rows = sorted(chosen.select("ids").mapInArrow(run, "w binary").toArrow().column("w").to_pylist())
    return np.frombuffer(b"".join(rows), np.int32).reshape(-1, WINDOW + 1).astype(np.int64)


def changes(encoded: DataFrame, model: Attention, groups: int = CHUNKS_LEAST) -> np.ndarray:
    """Sums of what ``groups`` local runs learn from all windows of all training
    texts, each window once.  Texts are dealt in pieces of PIECE windows;
    pieces, groups, the order of windows and the order of the sums follow hashes
    of the documents, so any layout gives the same model."""
    shared, size = encoded.sparkSession.sparkContext.broadcast(model), model.size

    def pieces(batches):
        kind, step = id_type(size + 2), WINDOW * PIECE
        for b in fl.slices(batches, "ids", IDS_BYTES):
            ids, off = stored_ids(b.column("ids"), size)
            who, number, parts = [], [], []
            for h, x, y in zip(b.column("h").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                line = np.concatenate([[size + 1], ids[x:y]]).astype(kind)
                some = range(0, y - x, step)
                who += [h] * len(some)
                number += range(len(some))
                parts += [line[k: k + step + 1].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(number, pa.int64()), pa.array(parts, pa.binary())], ["h", "number", "piece"])

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("number", "ascending"), ("piece", "ascending")])
        buf, off = fl.flat(t.column("piece").combine_chunks())
        kind = np.dtype(id_type(size + 2))
        ids, off = buf.view(kind), off // kind.itemsize
        start, end = windows_in(ids, off)
        order = np.random.default_rng(len(start)).permutation(len(start))  # a batch mixes texts

        def batches():
            for k in range(0, len(order), BATCH):
                w = order[k: k + BATCH]
                at = start[w, None] + np.arange(WINDOW + 1)
                yield np.where(at < end[w, None], ids[np.minimum(at, len(ids) - 1)].astype(np.int64), -1)

        mine = copy.copy(shared.value)
        mine.p = {k: v.copy() for k, v in mine.p.items()}
        total = mine.go_on(batches()).astype(np.float32)
        pa.default_memory_pool().release_unused()
        at = [k for k in range(0, len(total), PART) if total[k: k + PART].any()]
        return pa.table([pa.array(at, pa.int64()), pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array([total[k: k + PART].tobytes() for k in at], pa.binary())],
                        names=["at", "bucket", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("at").to_pylist(), b.column("sums").to_pylist()):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(x, np.float32).astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], ["at", "sums"])

    h = F.xxhash64("doc_id", "ids")
    dealt = encoded.where("not held_out").select(h.alias("h"), "ids").mapInArrow(pieces, "h long, number long, piece binary")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("h", "number", F.lit(7)), F.lit(groups)))  # a long text's pieces go to all groups
    learned = dealt.groupBy("bucket").applyInArrow(learn, "at long, bucket long, sums binary")
    out = np.zeros(sum(v.size for v in model.p.values()) + size + 2)
    for r in learned.repartition("at").sortWithinPartitions("at", "bucket").mapInArrow(add, "at long, sums binary").collect():
        x = np.frombuffer(r["sums"])
        out[r["at"]: r["at"] + len(x)] += x
    return out


def train(encoded: DataFrame, words: DataFrame, ends: int, size: int, groups: int = CHUNKS_LEAST, sample: int = SAMPLE) -> Attention:
    counts = subword_counts(words, size)
    heads = np.argsort(-counts, kind="stable")[:HEADS]
    model = Attention(size).know(counts, ends, neighbours(encoded, heads[counts[heads] > 0], size))
    model.fit(first_windows(encoded, size, int(counts.sum()), sample))
    return model.take(changes(encoded, model, groups))


# -- scoring -----------------------------------------------------------------
def score(docs: DataFrame, vocabulary=None, fold: int = 7, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score."""
    spark = docs.sparkSession
    shared = vocabulary or bpe.load(spark)
    docs = docs.select("doc_id", "text")
    about = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(crc_remainder(F.col("doc_id"), fold) != held, 1)).alias("ends")).first()
    ends = about["ends"]
    size = len(shared.value.token)
    chunks = max(CHUNKS_LEAST, -(-(about["bytes"] or 0) // CHUNK_BYTES))
    # dealt twice (words counted, texts encoded): the chunk must be the row's own, whatever order rows come in
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(chunks)))
    held_out = (crc_remainder(F.col("doc_id"), fold) == held).alias("held_out")
    words = lexicon(word_counts(dealt.select("chunk", held_out, "text")), shared, chunks)
    seen = words.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    asked = words.select(F.explode("chunks").alias("chunk"), "h", "c", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = float(n + v + 1)
        h = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], right.column("c").to_numpy()[order]
        ids_of, off_of = fl.flat(right.column("ids").combine_chunks() if right.num_rows else pa.array([], pa.binary()))
        ids_of, off_of = ids_of.view("<u4") if len(ids_of) else np.zeros(0, np.uint32), off_of // 4
        first, length = off_of[:-1][order], np.diff(off_of)[order]
        logc = np.log10((c + 1) / whole)
        out = []
        for b in fl.slices(left.to_batches()):
            woff, wh = fl.words(*fl.flat(b.column("text")), lower=True)[2:]
            u, back = np.unique(wh, return_inverse=True)
            w = np.searchsorted(h, u)[back]  # in order, as a search of each word would miss the cache
            if len(wh) and (not len(h) or (h[np.minimum(w, len(h) - 1)] != wh).any()):
                raise ValueError("a word of the chunk has no row in its lexicon")
            tokens = np.diff(woff) + 1
            csum = lambda a: (lambda s: s[woff[1:]] - s[woff[:-1]])(np.concatenate([[0], np.cumsum(a)]))
            base = np.array([logc[w[x:y]].sum() for x, y in zip(woff[:-1].tolist(), woff[1:].tolist())]) + np.log10((ends + 1) / whole)
            known = csum(c[w] > 0) + int(ends > 0)
            ln = length[w]
            at = np.concatenate([[0], np.cumsum(ln)])
            flat_ids = ids_of[np.repeat(first[w] - at[:-1], ln) + np.arange(at[-1])].astype(np.int64)
            flat_ids = np.insert(flat_ids, at[woff[1:]], size).astype(id_type(size))
            ioff = (at[woff] + np.arange(len(woff))) * flat_ids.itemsize
            stored_as = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ioff.astype(np.int32).tobytes()), pa.py_buffer(flat_ids.tobytes())])
            out.append(pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(tokens), n), pa.int64()),
                 pa.array(base, pa.float64()), stored_as],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "ids"]))
        if not out:
            return pa.table({"doc_id": pa.array([], left.schema.field("doc_id").type), **{x: pa.array([], pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")},
                             "base_score": pa.array([], pa.float64()), "ids": pa.array([], pa.binary())})
        pa.default_memory_pool().release_unused()  # a worker waits beside the next stages'
        return pa.Table.from_batches(out)

    encoded = stored(dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, ids binary").select("*", held_out), "lm-encoded")
    model = spark.sparkContext.broadcast(train(encoded, words, ends, size, chunks))  # a fixed size

    def apply(batches):
        for b in fl.slices(batches, "ids", IDS_BYTES):
            score = model.value.score(*stored_ids(b.column("ids"), size))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], [*b.schema.names[:-1], "score"])

    return encoded.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "ids").mapInArrow(
        apply, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
