"""Best-two-fit packing of token sequences.

Documents are cut into pieces of at most ``size`` tokens.  Pieces are dealt
into blocks of about BLOCK documents by a hash of their row number (equal
keys or copies don't meet in one block), and each block is packed on its
own: a bin is filled greedily with the longest pieces that fit; then its
smallest piece is replaced with two unpacked pieces when they fill the
expanded gap more tightly.  A block wastes less than one bin at its end, so
the loss against one global packing is under one bin in about a thousand.

Defined results: a null or empty text is the end id alone; repeated rows
are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import bpe
from tracefold.llm import flat as fl

BLOCK = 2048


def pieces(docs: DataFrame, vocabulary=None, size: int = 4096, end_id: int = 1, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each whole text."""
    shared = vocabulary or bpe.load(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = shared.value
        for b in fl.slices(batches):
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for i, x in enumerate(enc.encode_bytes(b.column("text").to_pylist())):
                x += tail
                for k in range(0, len(x), 4 * size):
                    part = x[k: k + 4 * size]
                    row.append(i)
                    piece.append(k // (4 * size))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        data.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                cols.append(pa.array(data, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths lie in 1..size."""
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    for i, n in enumerate(lengths.tolist()):
        stacks[n].append(i)
    count = np.bincount(lengths, minlength=size + 1)
    own = np.arange(size + 1)
    below = np.maximum.accumulate(np.where(count > 0, own, 0))  # longest unpacked length up to x

    def gone(n: int) -> None:
        nonlocal below
        count[n] -= 1
        if count[n] == 0:
            lower, m = below[n - 1], n
            stop = np.searchsorted(below[m:], n, "right") + m
            below[m:stop] = lower

    def two(room: int) -> tuple[int, int]:
        """The two unpacked pieces with the largest total of at most room."""
        a = own[1: min(room, size) + 1]
        a = a[count[1: len(a) + 1] > 0]
        a = a[a < room]
        if not len(a):
            return 0, 0
        b = below[np.minimum(room - a, size)]
        b = np.where((b == a) & (count[a] == 1), below[np.maximum(b - 1, 0)], b)
        k = int(np.argmax(np.where(b > 0, a + b, 0)))
        return (int(a[k]), int(b[k])) if b[k] > 0 else (0, 0)

    where, offset, made, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, len(lengths)
    while left:
        held, room = [], size
        while room and (n := int(below[room])):
            held.append(stacks[n].pop())
            gone(n)
            room -= n
        if room and len(held) > 1:
            least = int(lengths[held[-1]])  # filled from the longest down
            a, b = two(room + least)
            if a + b > least:
                back = held.pop()
                for n in (a, b):
                    held.append(stacks[n].pop())
                    gone(n)
                stacks[least].append(back)
                count[least] += 1
                if count[least] == 1:
                    low = np.searchsorted(below, least)
                    below[least: max(low, least)] = least
        at = 0
        for i in held:
            where[i], offset[i] = made, at
            at += int(lengths[i])
        left -= len(held)
        made += 1
    return where, offset


def assign(cut: DataFrame, n_docs: int, size: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces; other columns pass through."""
    blocks = max(1, -(-n_docs // BLOCK))

    def run(t: pa.Table) -> pa.Table:
        block = t.column("_block")[0].as_py()
        where, offset = best_two_fit(t.column("length").to_numpy(), size)
        t = t.drop_columns(["_block"])
        return t.append_column("sequence_id", pa.array((block << 32) | where, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("_block").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary=None, size: int = 4096, end_id: int = 1, ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place."""
    return assign(pieces(docs, vocabulary, size, end_id, ids), docs.count(), size)
