"""BPE and packing against the tokenizers library."""

import hashlib
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import MID, collected, texts
from tracefold.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())


def test_round_trip_equals_library(docs, library):
    def line(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert Counter(collected(bpe.round_trip(docs))) == Counter(line(i, t) for i, t in texts())


def test_frames_of_ids_and_texts(docs, library):
    enc = bpe.encode_documents(docs)
    assert Counter((i, tuple(x)) for i, x in collected(enc)) == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts())
    assert Counter(collected(bpe.decode_documents(enc))) == Counter(
        (i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in texts())


def test_sf_documents_equal_library(spark, library):
    rows = spark.read.parquet(f"{MID}/documents.parquet")
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.round_trip(rows).collect()}
    for r in rows.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(own, library, items):
    for ids, t in zip(own.encode(items), items):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("before", [":", "a", "q\u0301"])
def test_every_code_point(own, library, before):
    """Letters, numbers, lower-casing and composition of all of Unicode."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lines = [" ".join(before + c for c in points[k: k + 4096]) for k in range(0, len(points), 4096)]
    for line, ids, want in zip(lines, own.encode(lines), library.encode_batch(lines, add_special_tokens=False)):
        if ids.tolist() != want.ids:
            bad = [hex(ord(w[-1])) for w in line.split(" ") if w and own.encode([w])[0].tolist() != library.encode(w, add_special_tokens=False).ids]
            pytest.fail(f"{before!r} before {bad[:20]}")


def test_every_mark_in_order(own, library):
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c)) or unicodedata.category(chr(c)) in ("Mn", "Mc")]
    items = [s for c in marks for s in ("q" + c + "\u0323\u0301", "q\u0345" + c + "\u0334", "\U00011935" + c, "\u1100\u1161" + c)]
    for s, ids, want in zip(items, own.encode(items), library.encode_batch(items, add_special_tokens=False)):
        assert ids.tolist() == want.ids, ascii(s)


def test_full_caches_start_anew(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for t in ("some words go here", "more words go there, there"):
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def check_packing(rows, source, library, size, ids):
    """Pieces cover each document in order; sequences are gapless and within size."""
    at = {c: k for k, c in enumerate(("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "sequence_id", "offset"))}
    want = Counter()
    for i, t in source:
        x = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(x), size):
            part = x[k: k + size]
            want[i, k // size, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r[at["sequence_id"]]].append((r[at["offset"]], r[at["length"]]))
        if ids:
            assert len(r[5]) == r[3] and zlib.crc32(np.array(r[5], "<u4").tobytes()) == r[4]
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= size
    return len(bins), sum(r[3] for r in rows)


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_packing(docs, library, size):
    bins, tokens = check_packing(collected(packing.pack(docs, size=size)), texts(), library, size, True)
    assert bins <= -(-tokens // size) * 1.02 + 2


def test_packing_of_sf_documents_is_tight(spark, library):
    d = spark.read.parquet(f"{MID}/documents.parquet")
    bins, tokens = check_packing(collected(packing.pack(d, ids=False)), [(r["doc_id"], r["text"]) for r in d.collect()], library, 4096, False)
    assert bins <= -(-tokens // 4096) * 1.01 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_two_fit_is_a_packing(lengths):
    n = np.array(lengths, np.int64)
    where, offset = packing.best_two_fit(n, 50)
    for b in set(where.tolist()):
        end = 0
        for k in sorted(np.flatnonzero(where == b), key=lambda k: offset[k]):
            assert offset[k] == end
            end += n[k]
        assert end <= 50
    assert len(set(where.tolist())) <= 1.25 * -(-int(n.sum()) // 50) + 1


def test_two_replace_the_smallest():
    where, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)  # greedy 6+3 leaves 1; 6+2+2 is full
    assert where[0] == where[2] == where[3] != where[1]


def test_empty_tables(none):
    assert bpe.round_trip(none).count() == 0 and packing.pack(none).count() == 0 and bpe.encode_documents(none).count() == 0
