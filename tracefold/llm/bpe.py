"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words stand in one flat array.  In each round
the rank of every adjacent pair is found by binary search over the sorted
pair keys, each word's lowest rank is taken, all its occurrences are merged
(leftmost first, without overlap), and words without a mergeable pair leave.

Reads vocabulary files of the ``tokenizers`` library whose model is BPE on
bytes with a word-end suffix, NFC and lower-casing, and whose pre-tokens
never hold white space.  White-space-free pieces are therefore encoded on
their own, and each distinct piece only once per cache generation.

Results equal ``Tokenizer.encode(text, add_special_tokens=False)`` and
``Tokenizer.decode(ids, skip_special_tokens=False)``.  A null text counts as
empty: no ids, empty decoded text.  Input columns beside the id and the text
are ignored; rows repeat as they come.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracefold.llm import flat as fl

#: Distinct pieces and words kept per Python worker (about 250 MB); beyond it a cache starts anew.
CACHE_PIECES, CACHE_WORDS = 800_000, 500_000
_NONE = np.int64(1 << 40)
_MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: Unicode White_Space.
_PIECES = re.compile("[^\t-\r \x85\xa0  -     　]+")

# Where the library's Unicode tables differ from Python 3.13's.  Its
# letters and numbers are those of Unicode 16, its lower-casing that of Unicode 17,
# its composition knows none of the marks in NO_MARK (they stay where they are).
LETTERS_16 = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E
11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
LOWER_17 = """1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"""
NO_MARK = """7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50
10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42
16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""


def points(table: str) -> list[int]:
    """Code points of a table of hexadecimal ranges."""
    ends = [[int(x, 16) for x in r.split("-")] for r in table.split()]
    return [c for r in ends for c in range(r[0], r[-1] + 1)]


def lower_map() -> dict[int, int]:
    out = {}
    for r in LOWER_17.split():
        source, target = r.split(">")
        out.update({c: int(target, 16) + k for k, c in enumerate(points(source))})
    return out


def stand_ins() -> dict[int, str]:
    """For each code point whose class the pattern engine sees otherwise than
    the library does: a character that both see in the library's class."""
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    engine = {"L": set(regex.findall(r"\p{L}", text)), "N": set(regex.findall(r"\p{N}", text))}
    library: dict[str, set] = {"L": set(map(chr, points(LETTERS_16))), "N": set(map(chr, points(NUMBERS_16)))}
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind in library:
            library[kind].add(c)
    wrong = (engine["L"] ^ library["L"]) | (engine["N"] ^ library["N"])
    return {ord(c): "\u00aa" if c in library["L"] else "\u00b2" if c in library["N"] else "\u00a4" for c in wrong}


_YOUNG = re.compile("([" + "".join(map(chr, points(NO_MARK))) + "])")
_LOWER = lower_map()


def compose(text: str) -> str:
    """NFC as the library does it."""
    if text.isascii() or not _YOUNG.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", x) for x in _YOUNG.split(text))


def lower(text: str) -> str:
    """Lower-casing without regard to context, as the library does it."""
    low = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
    return low if low.isascii() else low.translate(_LOWER)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class WordBpe:
    """One vocabulary.  Build it on the driver from the file's text and ship
    it as a broadcast (a few MB, fixed by the file)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model, vocab = j["model"], j["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.made = key[order], made[order]
        self.rank = np.append(order.astype(np.int64), _NONE)
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.split = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "words", "find", "spans", "odd", "marks")} | {"ready": False}

    def prepare(self) -> None:
        if not self.ready:
            pattern = regex.compile(self.split)
            self.find, self.spans, self.odd = pattern.findall, pattern.finditer, stand_ins()
            self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
            self.cache: dict[str, bytes] = {}
            self.words: dict[str, bytes] = {}
            self.ready = True

    def _find(self, sym: np.ndarray, wid: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Places of the pairs that begin at ``where`` among the sorted keys,
        len(keys) for none, and one more of these."""
        key = (sym[where] << 32) | sym[where + 1]
        pos = np.searchsorted(self.keys, key)
        pos[(self.keys[np.minimum(pos, len(self.keys) - 1)] != key) | (wid[where] != wid[where + 1])] = len(self.keys)
        return np.append(pos, len(self.keys))

    # -- merge rounds ------------------------------------------------------
    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the words' offsets into it.
        Words must not be empty."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        wid = np.repeat(np.arange(len(words)), n)
        done_sym, done_wid = [], []
        at = self._find(sym, wid, np.arange(len(sym) - 1))  # place of each symbol's pair with the next
        while len(sym):
            rank = self.rank[at]
            new = np.ones(len(wid), bool)
            new[1:] = wid[1:] != wid[:-1]
            heads = np.flatnonzero(new)
            low = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(wid)))
            live = low < _NONE
            mask = np.repeat(live, size)
            if not live.all():
                done_sym.append(sym[~mask])
                done_wid.append(wid[~mask])
            if not live.any():
                break
            p = np.flatnonzero((rank == np.repeat(low, size)) & mask)
            if len(p) > 1:  # runs of overlapping pairs: every other one
                start = np.ones(len(p), bool)
                start[1:] = p[1:] != p[:-1] + 1
                p = p[(p - np.maximum.accumulate(np.where(start, p, 0))) % 2 == 0]
            sym[p] = self.made[at[p]]
            mask[p + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[p] = True
            sym, wid, at, fresh = sym[mask], wid[mask], at[mask], fresh[mask]
            fresh[:-1] |= fresh[1:]  # a merged symbol changes its pair and the one before
            at[-1:] = len(self.keys)
            where = np.flatnonzero(fresh[:-1])
            at[where] = self._find(sym, wid, where)[:-1]
        sym, wid = np.concatenate(done_sym or [np.zeros(0, np.int64)]), np.concatenate(done_wid or [np.zeros(0, np.int64)])
        order = np.argsort(wid, kind="stable")
        return sym[order].astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(wid, minlength=len(words)))])

    # -- pieces ------------------------------------------------------------
    def _parts(self, piece: str) -> list:
        """Pre-tokens (str) and special ids (int) of a piece."""
        out: list = []
        for k, part in enumerate(self.marks.split(piece) if self.marks and "<" in piece else [piece]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                low = lower(compose(part))
                if low.isalpha():
                    out.append(low)
                    continue
                seen = low if low.isascii() else low.translate(self.odd)
                out += self.find(low) if seen == low else [low[m.start(): m.end()] for m in self.spans(seen)]
        return out

    def learn(self, pieces) -> None:
        """Encode distinct pieces into the cache.  Letters with nothing or
        ASCII marks after them need no pattern search."""
        words, cache, simple, mixed = self.words, self.cache, {}, {}
        for p in pieces:
            core = p.rstrip(_MARKS)
            if core.isalpha() and (p.isascii() or "Σ" not in core and unicodedata.is_normalized("NFC", p)):
                low = core.lower()
                if len(core) == len(p):
                    simple[p] = low
                    continue
                ps = [low, p[len(core):]] if "<" not in p and low.isalpha() else self._parts(p)
            else:
                ps = self._parts(p)
            if len(ps) == 1 and isinstance(ps[0], str):
                simple[p] = ps[0]
            else:
                mixed[p] = ps
        odd = [p for p, w in simple.items() if not w.isascii() and not w.isalpha()]
        for p in odd:  # lower-casing gave a mark of its own
            ps = self._parts(p)
            if ps != [simple[p]]:
                del simple[p]
                mixed[p] = ps
        new = set(simple.values())
        new.update(w for ps in mixed.values() for w in ps if isinstance(w, str))
        new = list(new.difference(words))
        if new:
            ids, off = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
            data, ends = ids.tobytes(), (off * 4).tolist()
            words.update(zip(new, [data[a:b] for a, b in zip(ends, ends[1:])]))
        get = words.__getitem__
        cache.update(zip(simple, map(get, simple.values())))
        for p, ps in mixed.items():
            cache[p] = b"".join([get(w) if isinstance(w, str) else int(w).to_bytes(4, "little") for w in ps])

    def encode_bytes(self, texts: list) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.prepare()
        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        pieces = [_PIECES.findall(t) if t else [] for t in texts]
        self.learn(set().union(*pieces).difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def forget(self) -> None:
        """Drop the caches: for texts that don't come again."""
        self.prepare()
        self.cache, self.words = {}, {}

    def encode(self, texts: list) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.encode_bytes(texts)]

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: tokens joined by one space."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


_loaded: dict = {}


def load(spark, path: str | None = None):
    """Broadcast of the vocabulary at path (bounded by the file's size)."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(WordBpe(f.read()))


def encode_documents(docs: DataFrame, vocabulary=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each whole text."""
    shared = vocabulary or load(docs.sparkSession)

    def run(batches):
        bpe = shared.value
        for b in fl.slices(batches):
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [key, "ids"])

    src = docs.select(key, docs[text].alias("text"))
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary=None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): what the ids decode to; null ids give an empty text."""
    shared = vocabulary or load(encoded.sparkSession)

    def run(batches):
        bpe = shared.value
        for b in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string())], [key, "text"])

    src = encoded.select(key, encoded[ids].alias("ids"))
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary=None) -> DataFrame:
    """Encode and decode each whole text in one pass; per document: doc_id,
    n_tokens and SHA-256 digests of the ids and of the decoded text."""
    shared = vocabulary or load(docs.sparkSession)

    def run(batches):
        bpe = shared.value
        numbers = [str(i) for i in range(len(bpe.token))].__getitem__
        sha = hashlib.sha256
        for b in fl.slices(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode(b.column("text").to_pylist()):
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(numbers, ids.tolist())).encode()).hexdigest())
                text_sha.append(sha(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
