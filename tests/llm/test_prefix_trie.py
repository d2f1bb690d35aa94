"""Prefix trie of conversations against plain Python."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from crestline.llm import prefix_trie as P


def mark(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def ordered(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append(((turn is not None, turn or 0), mark(role, text), role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in found.items()}


def grafted(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for path, inside in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaf = lambda p: not any(q[:-1] == p for q in members if len(q) == len(p) + 1)
        rows.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside),
                     sum(1 for p in below if len(p) == len(path) + 1), sum(leaf(p) for p in below),
                     sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                     hashlib.sha256(",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(path)))).encode()).hexdigest()))
    return sorted(rows, key=repr)


def talk(seed, n, longest):
    """Conversations with shared beginnings, null fields, equal turns, ids below zero and missing group heads."""
    rng, rows = random.Random(seed), []
    ids = rng.sample([i for i in range(-12, n) if i % 7], n // 2)
    for c in ids:
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else rng.choice([t, t, t, 2])
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["hé", "hi", "", None, "a longer text"])))
    return rows + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize("block", [1, 4])
def test_whole_result(spark, block, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "IDS", 3)
    rows = talk(block, 60, 11)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    turns = P.written(P.ordered_turns(df), "test")
    assert sorted(map(tuple, P.trie(*P.grafted(turns)).collect()), key=repr) == nodes(grafted(ordered(rows)))


def test_plain_trie_with_long_and_repeated_conversations(spark):
    """One conversation with most of the rows and many copies of a short one."""
    rows = [(0, t, "user", f"turn {t % 3}") for t in range(400)] + [(1, t, "user", f"turn {t % 3}") for t in range(390)]
    rows += [(c, t, "user", f"turn {t}") for c in range(2, 40) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    got = {(r.depth, r.conv_id): r for r in P.conversation_trie(df).collect()}
    assert len(got) == 401 and got[0, 0].n_convs == 40 and got[0, 0].n_leaves == 1
    assert got[400, 0].n_children == 0 and got[390, 0].n_convs == 2 and got[2, 0].n_convs == 40
    assert got[2, 0].ends_sha256 == hashlib.sha256(",".join(map(str, range(2, 40))).encode()).hexdigest()
    assert got[0, 0].saved_tokens == 2 * 39 * 6 + 388 * 6


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = P.written(P.ordered_turns(df), "test")
    assert P.trie(*P.grafted(turns)).collect() == [] and P.conversation_trie(df).collect() == []
