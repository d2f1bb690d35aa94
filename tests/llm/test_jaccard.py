"""Jaccard components against all pairs."""
import random
import re

import numpy as np
import pytest

from crestline.llm import jaccard_join as J
from crestline.llm.components import connected_components


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def _brute(rows):
    root = {k: k for k, _ in rows if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [(k, _set(t)) for k, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=repr)


def _varied(seed):
    """Groups of near copies of different rates of change, passages in unrelated texts, and chains."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for size, rate in ((40, 0.02), (25, 0.05), (12, 0.005)):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(size):
            rows.append([w if rng.random() > rate else rng.choice(vocabulary) for w in base])
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(20):
        rows.append(list(chain))
        chain[i * 3 % 60] = rng.choice(vocabulary)
    for _ in range(60):
        rows.append([rng.choice(vocabulary) for _ in range(rng.randint(1, 12))] + passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))])
    rows += [r[:4] for r in rows[:20]] + rows[:15]
    rng.shuffle(rows)
    return [(i, " ".join(r).title() if i % 3 else "  ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("limits", [{}, {"PIVOTS": 3, "SALTED": 8, "LOCALLY_COMMON": 2, "BROADCAST_ROWS": 5}, {"LARGE": 0, "PIVOTS": 2}])
def test_components(spark, odd_docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    rows = _varied(len(limits)) + [(10_000 + (r.doc_id or 0), r.text) for r in odd_docs.collect()] + [(None, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=repr) == _brute(rows)


def test_table_and_selection(spark, docs, no_docs, odd_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = J.jaccard_components(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(rows)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in _brute(rows)})
    assert J.jaccard_components(no_docs).count() == 0
    assert J.one_of_each(odd_docs).where("doc_id = 0").count() == 1


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7), (500, 500), (None, 3)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100, 500: 500, **{1000 + i: 1000 for i in range(300)}}
    assert got == want


def test_bits_never_rule_out_a_link():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(600, 3000)
        x = {rng.getrandbits(64) for _ in range(n)}
        y = set(rng.sample(sorted(x), rng.randint(n // 2, n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 3))}
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        most = J._most(J._bits(a), J._bits(b), len(a), len(b))
        assert len(x & y) <= most <= min(len(x), len(y))
        assert len(x & y) > 0.65 * n or most < min(len(x), len(y))
    assert J._bits(np.zeros(J.LARGE, np.uint64)) is None


def test_a_pair_meets_in_few_of_its_regions(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    passages = [[rng.choice(vocabulary) for _ in range(12)] for _ in range(60)]
    own = [[p if rng.random() < 0.9 else [rng.choice(vocabulary) for _ in range(12)] for p in passages] for _ in range(24)]
    rows = [(i, " ".join(w for p in ps for w in p)) for i, ps in enumerate(own)]
    met, pairs = [], J._pairs

    def counted(frame, a, b):
        found = pairs(frame, a, b)
        if (a, b) == ("x", "y"):
            met.append((frame.count(), found.count()))
        return found

    monkeypatch.setattr(J, "_pairs", counted)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(rows)
    assert sum(p for _, p in met) > 50 and sum(m for m, _ in met) <= 3 * sum(p for _, p in met), met


def test_only_texts_of_pairs_are_moved(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(30):  # a shared passage, but sizes that cannot link
        words = [f"v{rng.randrange(10**9)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:40]))]
    rows.append((100, rows[0][1] + " end"))
    moved, packed = [], J._packed
    monkeypatch.setattr(J, "_packed", lambda texts: moved.append(texts.count()) or packed(texts))
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == _brute(rows)
    assert sum(moved) == 2
