"""Texts of an Arrow batch as one flat byte array.

Word spans, word hashes, shingles and line hashes are computed for all
documents of a slice at once with numpy, without a Python loop over words.
A null text counts as empty.  Slices are bounded by bytes; a document longer
than the bound is a slice of its own, so whole texts are always processed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_M = np.uint64
_Q = _M(0xD6E8FEB86659FD93)
END_HASH = _M(0x5851F42D4C957F2D)

#: Random constants of the span hash: before a block is mixed, per block number, per length.
_START, _STEP, _LENGTH = (_M(x) for x in np.random.default_rng(20240607).integers(1, 1 << 63, 3, dtype=np.uint64) * _M(2) + _M(1))
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _M(30))
    x = x * _M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M(27))
    x = x * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def slices(batches, text: str = "text", max_bytes: int = SLICE_BYTES):
    """Cut record batches so that each holds at most max_bytes of text, or
    one document."""
    for b in batches:
        if b.num_rows == 0:
            continue
        ln = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        if ln.sum() <= max_bytes:
            yield b
            continue
        at, acc = 0, 0
        for i, n in enumerate(ln.tolist()):
            if i > at and acc + n > max_bytes:
                yield b.slice(at, i - at)
                at, acc = i, 0
            acc += n
        yield b.slice(at)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string column."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    elif pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.large_string()), np.int64
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes inside each document: starts, ends, and the
    index of each document's first run (one more entry at the end)."""
    n = len(keep)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True                      # a document begins here (or the end)
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, keep[:-1]
    starts = np.flatnonzero(keep & (~prev | first[:-1]))
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, keep[1:]
    ends = np.flatnonzero(keep & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (none empty): its blocks of eight bytes
    are mixed, each with its number mixed again, and summed with the length.
    No block's share is a linear function of its bytes or its place, so no
    pattern of a text makes spans collide."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([_LOWER[buf] if lower else buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def blocks(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((eight[at].view("<u8").ravel() & _MASK[np.minimum(size, 8)]) ^ _START)

    size = ends - starts
    total = mix(blocks(starts, size))
    more = np.flatnonzero(size > 8)
    if len(more):
        count = (size[more] - 1) // 8                        # blocks after the first
        first = np.concatenate([[0], np.cumsum(count)])
        number = np.arange(first[-1]) - np.repeat(first[:-1], count) + 1
        at = np.repeat(starts[more], count) + 8 * number
        share = mix(blocks(at, np.repeat(ends[more], count) - at) + number.astype(np.uint64) * _STEP)
        total[more] += np.add.reduceat(share, first[:-1])
    return mix(total + size.astype(np.uint64) * _LENGTH)


def words(buf: np.ndarray, off: np.ndarray, lower: bool = False):
    """(starts, ends, word offsets per document, hashes) of [^\\x20\\x09-\\x0D]+."""
    starts, ends, woff = spans(IS_WORD[buf], off)
    return starts, ends, woff, span_hash(buf, starts, ends, lower)


def doc_of(woff: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def windows(wh: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows and the documents' offsets into them
    (none for documents with fewer than k words)."""
    n = np.maximum(np.diff(woff) - (k - 1), 0)
    out = np.concatenate([[0], np.cumsum(n)])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    m = len(wh) - (k - 1)
    g = wh[:m].copy()
    for j in range(1, k):
        g = g * _Q + wh[j: m + j]
    pos = np.repeat(woff[:-1] - out[:-1], n) + np.arange(out[-1])
    return mix(g[pos]), out


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each document (A-Z lower-cased) as
    hashes, and the documents' offsets into them.  Fewer than k words: the
    whole sequence is the one shingle; no word: the set is empty."""
    _, _, woff, wh = words(buf, off, lower=True)
    g, goff = windows(wh, woff, k)
    nw = np.diff(woff)
    short = np.flatnonzero((nw > 0) & (nw < k))
    if len(short):
        vals = []
        for i in short.tolist():
            h = _M(int(nw[i]))
            with np.errstate(over="ignore"):
                for w in wh[woff[i]: woff[i + 1]]:
                    h = h * _Q + w
            vals.append(h)
        g = np.insert(g, goff[short], mix(np.array(vals, np.uint64)))
        n = np.diff(goff)
        n[short] = 1
        goff = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(goff[:-1].tolist(), goff[1:].tolist()):
        if b - a > 1:
            g[a:b].sort()
    if len(g) == 0:
        return g, goff
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    heads = goff[:-1][np.diff(goff) > 0]
    keep[heads] = True
    c = np.concatenate([[0], np.cumsum(keep)])
    return g[keep], c[goff]
