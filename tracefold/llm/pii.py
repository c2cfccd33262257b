"""Personal data by base patterns and a skip-chain conditional random field.

The variables of a document are its words with a digit, ``@`` or ``+``; all
others carry no evidence and are outside.  A word inside a base span is
clamped to that kind.  Neighbouring words are joined by chain edges, and
distant ones that may name the same entity by skip edges: words with letters
to the next one that is equal without outer punctuation, numbers to the next
number with which they share their last SHORTEST digits or more (shorter
ones to the next equal one).  A number is
written in one word or in adjacent ones; the words are joined that hold the
same of the shared digits.  Loopy sum-product
message passing over the whole graph then gives every word a kind, so an
entity that a pattern catches once is labelled wherever it recurs in the
document, also in a form that the patterns miss.  Words labelled with a kind
outside base spans become added spans.

Unary weights are a multinomial logistic model, and the two pair tables are
smoothed co-occurrence ratios; both are fitted on counts over all documents,
whose labels are the base spans.

Defined results: a null or empty text has no span (the digest of the empty
string); rows repeat as they come; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import flat as fl

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"[+().-]*[0-9][0-9+().-]*")
#: Digits of a number at least; more than any kind has are not looked at.
SHORTEST, LONGEST = 7, 19


def _emails(text: str):
    """Leftmost matches; the part before ``@`` is the whole run of its
    letters, so only the runs that end at an ``@`` are looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _NO_DIGIT.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# -- the graph ---------------------------------------------------------------
_CLUE = np.zeros(256, bool)
_CLUE[[*range(48, 58), 64, 43]] = True
_STOPS = ",;:!?."
_OUTER = " \t\"'`()[]{}<>,;:!?."
N_FEATURES = 40


def word_features(w: str, prev: str, nxt: str) -> list[int]:
    """Indices of the binary features of a word between its neighbours."""
    core = w.strip(_OUTER)
    digits = sum(c.isdigit() and c.isascii() for c in core)
    dots, dashes = core.count("."), core.count("-")
    f = [0, 1 + min(digits, 12) if digits < 12 else (13 if digits <= 19 else 14), 15 + min(dots, 4)]
    flags = ("@" in core, core.startswith("+"), "(" in w, dashes > 0, core.isdigit(), any(c.isalpha() for c in core),
             "=" in core, prev.startswith("+"), nxt.startswith("("), bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", core)),
             bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", core)), "@" in core and "." in core.partition("@")[2],
             bool(re.fullmatch(r"\([0-9]{3}\)", w.strip(",;."))), len(core) > 24)
    return f + [20 + k for k, on in enumerate(flags) if on]


def word_key(w: str) -> str:
    """What distant words must share to be linked, if they are not numbers
    of SHORTEST digits; '' for none."""
    core = w.strip(_OUTER).lower()
    digits = sum(c.isdigit() and c.isascii() for c in core)
    return core if len(core) >= 6 and (digits >= 4 or "@" in core) else ""


def number(w: str) -> str:
    """The digits of a word that is a number or a part of one; else ''."""
    return _NO_DIGIT.sub("", w) if _NUMBER.fullmatch(w.strip(_OUTER)) else ""


class Numbers:
    """The numbers of one document, and the skip edges between them.

    A number may end at any word of a run of adjacent number words and begin
    at any earlier one, so each word's last digits, back to the run's begin,
    are looked up, the longest first.  Digits beyond LONGEST don't count."""

    def __init__(self):
        self.seen: dict[str, list] = {}
        self.run: list[tuple[int, int]] = []   # (variable, digits in it), no more than LONGEST digits
        self.digits = ""
        self.wait: list[tuple[int, list, str]] = []

    def stop(self) -> None:
        """The run ends; what it names can recur from now on."""
        self._settle(None)
        self.run, self.digits = [], ""

    def _settle(self, before: int | None) -> None:
        """Numbers that end before this variable can be met."""
        while self.wait and (before is None or self.wait[0][0] < before):
            _, owner, digits = self.wait.pop(0)
            for n in range(SHORTEST, len(digits) + 1):
                self.seen[digits[-n:]] = owner

    def add(self, me: int, digits: str) -> set[tuple[int, int]]:
        """Pairs of variables with the same digits, this word being the last."""
        self.digits = (self.digits + digits)[-LONGEST:]
        self.run.append((me, min(len(digits), LONGEST)))
        over = sum(n for _, n in self.run) - LONGEST
        while over > 0:
            v, n = self.run[0]
            self.run[:1] = [(v, n - over)] if n > over else []
            over -= n
        if len(self.digits) < SHORTEST:
            return set()
        owner = [v for v, n in reversed(self.run) for _ in range(n)]   # of the last digit, of the one before ...
        self._settle(owner[SHORTEST - 1])
        self.wait.append((me, owner, self.digits))
        for n in range(len(self.digits), SHORTEST - 1, -1):
            if past := self.seen.get(self.digits[-n:]):
                return {(i, j) for i, j in zip(past[:n], owner[:n]) if i < owner[n - 1]}
        return set()


class Graph:
    """The variables and edges of the documents of one slice."""

    def __init__(self, texts: pa.Array):
        buf, off = fl.flat(texts)
        starts, ends, woff = fl.spans(fl.IS_WORD[buf], off)
        clue = np.flatnonzero(_CLUE[buf])
        var = np.unique(np.searchsorted(starts, clue, "right") - 1) if len(clue) else np.zeros(0, np.int64)
        doc = np.searchsorted(woff, var, "right") - 1
        self.bases: dict[int, list] = {}
        self.doc, self.word, self.start, self.end, self.label, self.features = [], [], [], [], [], []
        links: list[tuple[int, int, int]] = []
        points = np.concatenate([[0], np.cumsum(code_points(buf), dtype=np.int64)]) if len(var) else None
        seen: dict[tuple[int, str], int] = {}
        skips: set[tuple[int, int]] = set()
        numbers, within, open_ = Numbers(), None, False
        raw = buf.tobytes() if len(var) else b""
        word = lambda k: raw[starts[k]: ends[k]].decode("utf-8", "replace")
        for v, d in zip(var.tolist(), doc.tolist()):
            if d not in self.bases:
                self.bases[d] = base_spans(texts[d].as_py())
                base, numbers = self.bases[d], Numbers()
            first = points[off[d]]
            a, b = int(points[starts[v]] - first), int(points[ends[v]] - first)
            over = [x for x in base if x[0] < b and a < x[2]] if base else []
            hit = [k for _, k, _ in over]
            w = word(v)
            prev = word(v - 1) if v > woff[d] else ""
            nxt = word(v + 1) if v + 1 < woff[d + 1] else ""
            me = len(self.doc)
            adjacent = me > 0 and self.word[-1] == v - 1 and self.doc[-1] == d
            if adjacent:
                links.append((me - 1, me, 0))
            entity = next((x for x in over if x[1] >= KINDS.index("card")), None)
            digits = _NO_DIGIT.sub("", w[max(entity[0] - a, 0): entity[2] - a]) if entity else number(w)
            if not (digits and open_ and entity == within and adjacent):
                numbers.stop()
            if digits:
                skips |= numbers.add(me, digits)
            if len(digits) < SHORTEST and (key := word_key(w)):
                if (d, key) in seen:
                    skips.add((seen[d, key], me))
                seen[d, key] = me
            open_, within = bool(digits) and (entity is not None or w[-1] not in _STOPS), entity
            lead = len(w) - len(w.lstrip(_OUTER.replace("(", "") if ")" in w else _OUTER))
            tail = len(w) - len(w.rstrip(_OUTER))
            self.doc.append(d)
            self.word.append(v)
            self.start.append(a + min(lead, b - a))
            self.end.append(b - min(tail, b - a))
            self.label.append(1 + hit[0] if hit else 0)
            self.features.append(word_features(w, prev, nxt))
        links += [(i, j, 1) for i, j in sorted(skips) if self.word[i] != self.word[j] - 1]
        self.links = np.array(links, np.int64).reshape(-1, 3)
        self.label = np.array(self.label, np.int64)

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.doc), N_FEATURES), np.float32)
        for i, f in enumerate(self.features):
            x[i, f] = 1
        return x


def code_points(buf: np.ndarray) -> np.ndarray:
    return (buf & 0xC0) != 0x80


class SkipChain:
    """Weights of the field and its message passing."""

    def __init__(self):
        self.w = np.zeros((N_FEATURES, 1 + len(KINDS)))
        self.w[0, 0] = 4.0  # without training every word is outside
        self.pair = np.zeros((2, 1 + len(KINDS), 1 + len(KINDS)))

    def fit(self, x: np.ndarray, y: np.ndarray, pairs: np.ndarray, steps: int = 300, rate: float = 1.0, ridge: float = 1e-4) -> "SkipChain":
        """x: rows of features with their count in the last column; pairs:
        (type, label, label, count)."""
        if len(x) == 0:
            return self
        weight = x[:, -1] / x[:, -1].sum()
        x = x[:, :-1].astype(np.float64)
        goal = np.eye(1 + len(KINDS))[y]
        w = np.zeros_like(self.w)
        square = np.full_like(self.w, 1e-8)
        for _ in range(steps):  # Adagrad on the weighted multinomial likelihood
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - goal) * weight[:, None]) + ridge * w
            square += g * g
            w -= rate * g / np.sqrt(square)
        self.w = w
        for t in range(2):
            n = np.full((1 + len(KINDS), 1 + len(KINDS)), 0.5)
            for k, a, b, c in pairs[pairs[:, 0] == t].tolist() if len(pairs) else []:
                n[a, b] += c
                n[b, a] += c
            share = n.sum(1) / n.sum()
            self.pair[t] = np.clip(np.log(n / n.sum() / np.outer(share, share)), -4, 4)
        return self

    def label(self, g: Graph) -> np.ndarray:
        """Each variable's marginal distribution by loopy sum-product."""
        k = 1 + len(KINDS)
        unary = g.matrix() @ self.w if g.doc else np.zeros((0, k))
        unary[g.label > 0] = -30.0
        unary[g.label > 0, g.label[g.label > 0]] = 0.0
        belief = unary.copy()
        if len(g.links):
            src = np.concatenate([g.links[:, 0], g.links[:, 1]])
            dst = np.concatenate([g.links[:, 1], g.links[:, 0]])
            table = np.exp(self.pair[np.concatenate([g.links[:, 2]] * 2)])
            back = np.concatenate([np.arange(len(g.links), 2 * len(g.links)), np.arange(len(g.links))])
            message = np.zeros((len(src), k))
            for _ in range(ROUNDS):
                out = belief[src] - message[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ea,eab->eb", out, table))
                message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
                belief = unary.copy()
                np.add.at(belief, dst, message)
        p = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        return p / p.sum(1, keepdims=True) if len(p) else p


def find(texts: pa.Array, model: SkipChain) -> tuple[list, list]:
    """Base spans and all spans of each text."""
    g = Graph(texts)
    base = [g.bases.get(i, []) for i in range(len(texts))]
    every = [list(b) for b in base]
    if len(g.doc):
        p = model.label(g)
        kind = p.argmax(1)
        for i in np.flatnonzero((kind > 0) & (g.label == 0) & (p.max(1) > 0.5)).tolist():
            d, a, b, k = g.doc[i], g.start[i], g.end[i], int(kind[i]) - 1
            if a >= b or any(s < b and a < e for s, _, e in base[d]):
                continue
            prior = every[d][-1] if len(every[d]) > len(base[d]) else None
            if prior and prior[1] == k and g.word[i - 1] == g.word[i] - 1 and g.end[i - 1] == prior[2]:
                every[d][-1] = (prior[0], k, b)  # the next word of the same entity
            else:
                every[d].append((a, k, b))
        for s in every:
            s.sort()
    return base, every


def train(docs: DataFrame) -> SkipChain:
    """Fit on all documents.  Tasks send counts of distinct feature rows and
    label pairs, not texts."""
    def run(batches):
        for b in fl.slices(batches):
            g = Graph(b.column("text"))
            keys = Counter("u:" + " ".join(map(str, f)) + f":{y}" for f, y in zip(g.features, g.label.tolist()))
            keys.update(f"p:{t} {g.label[i]} {g.label[j]}:0" for i, j, t in g.links.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.keys(), pa.string()), pa.array(keys.values(), pa.int64())], ["key", "n"])

    rows = docs.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # distinct small feature sets
    x, y, pairs = [], [], []
    for r in sorted(rows, key=lambda r: r["key"]):
        kind, what, label = r["key"].split(":")
        if kind == "u":
            row = np.zeros(N_FEATURES + 1)
            row[list(map(int, what.split()))] = 1
            row[-1] = r["n"]
            x.append(row)
            y.append(int(label))
        else:
            pairs.append([*map(int, what.split()), r["n"]])
    return SkipChain().fit(np.array(x).reshape(-1, N_FEATURES + 1), np.array(y, np.int64), np.array(pairs, np.int64).reshape(-1, 4))


def detect(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """Per document: doc_id, base counts by kind, the digest of the base
    spans, all spans and the number of added ones."""
    model = model or train(docs)

    def run(batches):
        for b in fl.slices(batches):
            base, every = find(b.column("text"), model)
            count = [[sum(k == i for _, k, _ in s) for s in base] for i in range(len(KINDS))]
            sha = [hashlib.sha256(show(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in count], pa.array(sha, pa.string()), pa.array([show(s) for s in every], pa.string()),
                 pa.array([len(e) - len(s) for s, e in zip(base, every)], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redact(text: str, spans) -> str:
    """Replace each span by its kind; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """The rows, all columns, with personal data in ``text`` replaced and
    ``n_chars``, if there, counted anew for the changed texts."""
    model = model or train(docs)
    names = docs.columns

    def run(batches):
        for b in fl.slices(batches):
            _, every = find(b.column("text"), model)
            hit = [i for i, s in enumerate(every) if s]
            if hit:
                texts = b.column("text").to_pylist()
                for i in hit:
                    texts[i] = redact(texts[i], every[i])
                b = b.set_column(names.index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
                if "n_chars" in names:
                    n, field = b.column("n_chars").to_pylist(), b.schema.field("n_chars")
                    for i in hit:
                        n[i] = len(texts[i])
                    b = b.set_column(names.index("n_chars"), field, pa.array(n, field.type))
            yield b

    return docs.mapInArrow(run, docs.schema)
