"""Prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import collected, prose
from tracefold.llm import trie


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, own in convs.items():
        h, b = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = convs.get(b, [])[:h] + own[h:]
    return out


def brute(paths):
    """Rows of the trie of {conversation: list of turns}."""
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    name = {k: min(v) for k, v in members.items()}
    kids, leaves, saved = Counter(), Counter(), Counter()
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    return sorted((name[k], len(k), name[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k],
                   sha(",".join(str(c) for c in sorted(v) if len(paths[c]) == len(k)))) for k, v in members.items())


def table(spark, rows):
    shape = "conv_id long, turn long, role string, text string, pos int, depth string, g long"
    return spark.createDataFrame([(*r, 3, "x", 1) for r in rows], shape).repartition(5)


def conversations(seed):
    r = random.Random(seed)
    pool = [prose(k, r.randint(1, 5)) for k in range(4)] + ["", None, "é ß"]
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(250, 290), 300, 401, -5, -100, -101, 7000]:
        for t in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(pool)))
    same = [(t, "user", f"turn {t}") for t in range(6)]
    for c in range(500, 560):                                  # a common conversation, its prefixes and extensions
        rows += [(c, *x) for x in same[: 6 if c % 3 else c % 6 + 1]] + ([(c, 9, "user", "more")] if c % 7 == 0 else [])
    rows += [(3, None, "user", "first"), (3, 0, "user", "again"), (3, 0, "user", "again"), (3, 0, "a", "again"), (None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, seed):
    rows = conversations(seed)
    assert sorted(collected(trie.prefix_trie(table(spark, rows)))) == brute(rebuilt(rows))


def test_long_and_turnless_conversations(spark):
    one = next(c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, t, "user", f"t{t % 3}") for c in (100, 101, 102) for t in range(70 + c % 3)] + [(one, 0, "user", "gone")]  # no conversation 0: nothing is left of it
    want = brute(rebuilt(rows))
    assert rebuilt(rows)[one] == [] and sorted(collected(trie.prefix_trie(table(spark, rows)))) == want
    only = [(one, 0, "user", "gone")]
    assert collected(trie.prefix_trie(table(spark, only))) == brute({one: []}) == [(one, 0, None, 1, 0, 1, 0, sha(str(one)))]


def test_no_rows(spark):
    assert trie.prefix_trie(table(spark, [])).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_digests_of_a_large_node(spark):
    ends = spark.range(5000).selectExpr("if(id % 5 = 0, id, 7) AS conv_id", "id % 5 AS depth", "id AS member").where("depth < 4")
    want = defaultdict(list)
    for c, d, m in collected(ends):
        want[c, d].append(m)
    got = {(c, d): h for c, d, h in collected(trie.digests(ends.repartition(6)))}
    assert got == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}
