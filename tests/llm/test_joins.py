"""The n-gram Jaccard join against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import MID, collected, texts
from tests.llm.test_tables import WORD
from tracefold.llm import flat as fl
from tracefold.llm import jaccard, lm, rules

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k: k + 5]) for k in range(len(w) - 4)])


def brute(rows) -> Counter:
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[top(k)] = top(j)
    name = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[top(k)].append(i)
    return Counter((i, len(sets[k]), min(name[top(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_components(docs):
    assert Counter(collected(jaccard.join_components(docs))) == brute(texts())


def test_chains_groups_and_passages(spark):
    """A large group of near copies, chains of links, and a passage that many
    different documents share."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, base, passage = [], [word() for _ in range(120)], [word() for _ in range(55)]
    for k in range(150):
        w = list(base)
        w[r.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    chain = [word() for _ in range(60)]
    for k in range(30):
        chain = [*chain[1:], word()]
        rows.append((1000 + k, " ".join(chain)))
    for k in range(120):
        own = [word() for _ in range(r.randrange(10, 400))]
        rows.append((2000 + k, " ".join(own[:5] + passage + own[5:])))
    for k in range(200):
        rows.append((3000 + k, " ".join(r.choice("xyz") for _ in range(r.randrange(1, 14)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(collected(jaccard.join_components(df))) == brute(rows)


def test_sf_documents(spark):
    d = spark.read.parquet(f"{MID}/documents.parquet").limit(400)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(collected(jaccard.join_components(df))) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 9, 10, 14, 20, 25, 33, 60, 150, 700])
def test_linked_sets_always_share_a_signature(size):
    """Whichever rows a set leaves out, it finds its partner if it has enough
    of them; two sets with too few share a row of their own."""
    rng = np.random.default_rng(size)
    pick = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    few = 0
    for _ in range(300):
        common = pick(size)
        room = size // 3  # union at most 4/3 of the common part
        a, b = (lambda k: (rng.integers(0, k + 1), k))(rng.integers(0, room + 1))
        x, y = np.sort(np.concatenate([common, pick(a)])), np.sort(np.concatenate([common, pick(b - a)]))
        assert 100 * size >= 75 * (size + b)
        larger = max(len(x), len(y))
        scheme = next(k for k, (low, high, _) in enumerate(jaccard.bands(larger)) if low <= larger <= high)
        (sx, kx, tx), (sy, ky, ty) = jaccard.signatures(x), jaccard.signatures(y)
        lacking = 0
        for probe, other, tag in ((sx, sy, tx), (sy, sx, ty)):
            own = tag % 2000 == scheme
            spare = int(tag[own][0]) // 2000
            if spare >= jaccard.FEW:
                lacking += 1
            else:
                assert np.isin(probe[own], other).sum() > spare, (len(x), len(y))
        if lacking == 2:
            few += 1
            both = [(k, j) for s, k, t in zip(sx.tolist(), kx.tolist(), tx.tolist()) for j in ky[sy == s].tolist() if t % 2000 in (scheme, scheme + 1000)]
            assert any((k, j) != (2, 2) for k, j in both), (len(x), len(y))
    assert few < 30


@pytest.mark.parametrize("dear, turns", [(0, 1), (10**9, 1), (2, 2)])
def test_each_way_of_meeting_is_complete(spark, monkeypatch, dear, turns):
    """All sets by single shingles; all by segments; both mixed."""
    monkeypatch.setattr(jaccard, "DEAR", dear)
    monkeypatch.setattr(jaccard, "HUB_TURNS", turns)
    r = random.Random(dear + turns)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for k in range(12):
        base = [word() for _ in range(r.choice([8, 14, 30, 90, 200]))]
        base = base[:4] + passage[: r.randrange(41)] + base[4:]
        for j in range(r.choice([3, 12])):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = word()
            rows.append((1000 * k + j, " ".join(w[: len(w) - r.randrange(len(w) // 4 + 1)])))
    rows += [(50_000 + k, " ".join(r.choice("xy") for _ in range(r.randrange(1, 9)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(collected(jaccard.join_components(df))) == brute(rows)


def test_components_of_a_long_path(spark):
    path = list(range(200))
    random.Random(1).shuffle(path)
    e = spark.createDataFrame([*zip(path, path[1:]), (900, 901), (901, 900)], "a long, b long")
    got = dict(collected(jaccard.components(e)))
    assert set(got) == {*path, 900, 901} and {got[k] for k in path} == {0} and got[901] == 900


def test_one_of_each_group_stays(docs):
    kept = jaccard.keep_documents(docs)
    assert kept.schema == docs.schema
    want = {(1, None), (2, ""), (3, " \n\t\r "), (None, None)}  # without words
    for c in {c for i, n, c in brute(texts()) if n}:
        (row,) = {(i, t) for (i, t) in texts() if i == c and (i, len(shingles(t)), c) in brute(texts()) and (i != 12 or t.startswith("another"))}
        want.add(row)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)


def test_repeated_rows_and_missing_ids(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, t), (None, t), (None, "other words only"), (7, "p q"), (7, "p q"), (7, "p  q"), (8, "P q"), (None, "p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r["doc_id"] for r in jaccard.keep_documents(df).collect()) == Counter([None, None, 7])


def test_empty_table(none):
    assert jaccard.join_components(none).count() == 0 and jaccard.keep_documents(none).count() == 0


def thue_morse(a: str, b: str, n: int = 1024) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_spans_with_patterned_bytes_do_not_collide():
    rng = np.random.default_rng(8)
    spans = {thue_morse("a", "b"), thue_morse("b", "a"), *("ab" * k for k in range(1, 60)), *("a" * k for k in range(1, 200)), *("\0" * k for k in range(1, 40))}
    spans |= {"".join(rng.choice(list("xy"), 40)) for _ in range(3000)}
    one, two = thue_morse("abcdefgh", "hgfedcba", 64), thue_morse("hgfedcba", "abcdefgh", 64)  # whole blocks in other places
    spans = sorted(spans | {one, two})
    raw = [t.encode() for t in spans]
    ends = np.cumsum([len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    h = fl.span_hash(buf, ends - [len(r) for r in raw], ends)
    assert len(np.unique(h)) == len(spans)
    again = np.concatenate([fl.span_hash(np.frombuffer(b"..." + r + b"~", np.uint8), np.array([3]), np.array([3 + len(r)])) for r in raw])
    assert (again == h).all()  # the same anywhere in a buffer
    up = np.frombuffer(b"ABCZ[@abcz", np.uint8)
    assert fl.span_hash(up, np.array([0]), np.array([4]), lower=True) == fl.span_hash(up, np.array([6]), np.array([10]))


def test_patterned_words_and_lines_stay_apart(spark):
    """Words that only a hash of patterned bytes could take for one."""
    tail = " ".join(f"w{i}" for i in range(3))
    one, two = (thue_morse(*x) for x in ("ab", "ba"))
    rows = [(1, f"{one} {tail} {one}"), (2, f"{two} {tail} {two}"), (3, f"{one} {tail} {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.join_components(df).collect()} == {(1, 1), (2, 2), (3, 1)}
    lines = spark.createDataFrame([(1, f"{one}\n{two}\n{one}")], "doc_id long, text string")
    assert rules.signals(lines).first()["n_dup_lines"] == 1
    scored = {r["doc_id"]: r["n_known"] for r in lm.score(df.where("doc_id < 3")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in (1, 2)}
    train = {w for i, t in rows[:2] if not held[i] for w in t.split(" ")}
    assert scored == {i: 1 + sum(w in train for w in t.split(" ")) for i, t in rows[:2]}
