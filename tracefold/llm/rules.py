"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample (up to
SAMPLE documents of at most SAMPLE_BYTES from the table's first partitions,
documented parameters); the rules then run in the order of rejections per second.  A rule sees only the
documents that no earlier rule has rejected.  The order changes the time,
never the verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words, so every count is 0 and
the base check (fewer than 50 words) fails it.  Rows repeat as they come;
an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import flat as fl

SAMPLE, SAMPLE_BYTES = 512, 1 << 16
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LOWER = np.zeros(256, bool)
_IS_LOWER[97:123] = True
_IS_START = np.ones(256, bool)       # first byte of a code point
_IS_START[0x80:0xC0] = False


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags of each document."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


class Signals:
    """Counts of the documents of one slice; each is computed when first
    asked for."""

    def __init__(self, col: pa.Array):
        self.col = col
        self.buf, self.off = fl.flat(col)
        self._known: dict = {}

    def take(self, idx: np.ndarray) -> "Signals":
        """The signals of some documents, with all that is known of them."""
        if len(idx) == len(self.off) - 1:
            return self
        out = Signals(self.col.take(pa.array(idx)))
        for name, value in self._known.items():
            if name == "words":
                starts, ends, woff, wh = value
                size, first = np.diff(woff)[idx], woff[:-1][idx]
                new = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(first - new[:-1], size) + np.arange(new[-1])
                shift = np.repeat(out.off[:-1] - self.off[:-1][idx], size)
                out._known[name] = (starts[at] + shift, ends[at] + shift, new, wh[at])
            else:
                out._known[name] = tuple(x[idx] for x in value) if isinstance(value, tuple) else value[idx]
        return out

    def get(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, "_" + name)()
        return self._known[name]

    def _words(self):
        return fl.words(self.buf, self.off)

    def _n_words(self):
        return np.diff(self.get("words")[2])

    def _word_chars(self):
        return per_doc(fl.IS_WORD[self.buf] & _IS_START[self.buf], self.off)

    def _n_symbols(self):
        return per_doc(_IS_SYMBOL[self.buf], self.off)

    def _upper(self):
        return per_doc(_IS_UPPER[self.buf], self.off)

    def _lower(self):
        return per_doc(_IS_LOWER[self.buf], self.off)

    def _lines(self):
        """Of the lines with a word: how many, and how many equal an earlier one."""
        starts, _, woff, _ = self.get("words")
        n_docs = len(self.off) - 1
        if not len(starts):
            return np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        ls, le, _ = fl.spans(self.buf != 10, self.off)
        at = np.unique(np.searchsorted(ls, starts, "right") - 1)  # lines that hold a word
        doc = np.searchsorted(self.off, ls[at], "right") - 1
        key = fl.span_hash(self.buf, ls[at], le[at]) ^ fl.mix(doc.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(at), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return np.bincount(doc, minlength=n_docs), np.bincount(doc[again], minlength=n_docs)

    def _n_lines(self):
        return self.get("lines")[0]

    def _n_dup_lines(self):
        return self.get("lines")[1]

    def _n_repeat_words(self):
        _, _, woff, wh = self.get("words")
        g, goff = fl.windows(wh, woff, 3)
        if not len(g):
            return np.zeros(len(woff) - 1, np.int64)
        key = g ^ fl.mix(fl.doc_of(goff).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(g), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        pos = np.flatnonzero(twice)
        pos = pos + np.repeat(woff[:-1] - goff[:-1], np.diff(goff))[pos]
        cover = np.zeros(len(wh), bool)
        for j in range(3):
            cover[pos + j] = True
        return per_doc(cover, woff)

    def _n_stutter(self):
        """Words equal to the word before."""
        _, _, woff, wh = self.get("words")
        same = np.zeros(len(wh), bool)
        same[1:] = wh[1:] == wh[:-1]
        same[woff[:-1][np.diff(woff) > 0]] = False
        return per_doc(same, woff)


#: name -> which documents the rule rejects.
RULES: dict[str, Callable[[Signals], np.ndarray]] = {
    "few_words": lambda s: s.get("n_words") < 50,
    "repeats": lambda s: 100 * s.get("n_repeat_words") > 50 * s.get("n_words"),
    "symbols": lambda s: 4 * s.get("n_symbols") > s.get("n_words"),
    "copied_lines": lambda s: 2 * s.get("n_dup_lines") > s.get("n_lines"),
    "word_length": lambda s: (s.get("word_chars") > 15 * s.get("n_words")) | (s.get("word_chars") < 2 * s.get("n_words")),
    "shouting": lambda s: s.get("upper") > s.get("lower"),
    "stutter": lambda s: 10 * s.get("n_stutter") > 3 * s.get("n_words"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Rule names by falling rejections per second on the sample.  Spark reads
    only as many partitions as the sample needs."""
    some = docs.select("text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).limit(sample).collect()
    seen = {}
    for name, rule in RULES.items():
        s = Signals(pa.array([r["text"] for r in some], pa.string()))
        start = time.perf_counter()
        hits = int(rule(s).sum())
        seen[name] = hits / max(time.perf_counter() - start, 1e-9)
    return sorted(RULES, key=lambda n: (-seen[n], n))


def cascade(s: Signals, order: list[str]) -> np.ndarray:
    """Which documents pass every rule."""
    kept = np.ones(len(s.off) - 1, bool)
    alive = np.arange(len(kept))
    for name in order:
        if not len(alive):
            break
        ok = ~RULES[name](s)
        if not ok.all():
            kept[alive[~ok]] = False
            alive = alive[ok]
            s = s.take(np.flatnonzero(ok))
    return kept


def signals(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept."""
    order = order or measure(docs)

    def run(batches):
        for b in fl.slices(batches):
            s = Signals(b.column("text"))
            base = {c: s.get(c) for c in BASE}
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            kept = ~failed & cascade(s, order)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, pa.int64()) for v in base.values()], pa.array(failed), pa.array(kept)],
                                             ["doc_id", *BASE, "base_failed", "kept"])

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean")


def keep_documents(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows, all columns, of the documents that no rule rejects."""
    order = order or measure(docs)

    def run(batches):
        for b in fl.slices(batches):
            yield b.filter(pa.array(cascade(Signals(b.column("text")), order)))

    return docs.mapInArrow(run, docs.schema)


#: DuckDB SQL for the query's rows; words and lines as in the contract.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
tok AS (SELECT r, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
tri AS (SELECT r, i, x, lag(x) OVER p AS before, lead(x) OVER p AS x2, lead(x, 2) OVER p AS x3 FROM tok WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, x2, x3) AS c FROM tri WHERE x3 IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range(3) g(j) GROUP BY r),
stu AS (SELECT r, count(*) AS n FROM tri WHERE x = before GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t),
dup AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.d, 0)::BIGINT AS n_dup_lines, coalesce(dup.n, 0) AS n_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(stu.n, 0) AS stutter, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lo
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN stu USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR up > lo OR 10 * stutter > 3 * n_words) AS kept FROM g
"""
