"""Counts and base scores against plain Python; the model is a distribution and beats the base on held-out texts."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crestline.llm import language_model as L


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [L.END]


@pytest.mark.parametrize("block", [L.BLOCK, 2000])
def test_base_scores(spark, odd_docs, docs, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = odd_docs.where("doc_id IS NOT NULL").select((odd_docs.doc_id + 100_000).alias("doc_id"), "text").dropDuplicates(["doc_id"]).unionByName(docs.select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    test = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(t for k, x in texts.items() if not test[k] for t in _tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = L.score(rows).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens = _tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (test[r.doc_id], len(tokens), sum(t in counts for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_learns_and_is_normalised():
    draw = np.random.default_rng(3)
    symbols = np.zeros(60_000, np.int32)
    for i in range(1, len(symbols)):  # each symbol is followed by one of two others
        symbols[i] = (symbols[i - 1] * 3 + draw.integers(1, 3)) % 20
    sizes = np.array([len(symbols)])
    one, two = L._triples(symbols, sizes)
    model = L.Model(np.bincount(symbols, minlength=20).astype(float))
    before = model.logs(one, two, symbols).mean()
    for _ in range(20):
        model.learn(one, two, symbols, draw)
    after = model.logs(one, two, symbols).mean()
    assert after > before + 1 and after <= math.log(0.5) + 0.1
    every = np.arange(20)
    assert math.isclose(np.exp(model.logs(np.full(20, 4), np.full(20, 7), every)).sum(), 1, rel_tol=1e-4)


def test_empty_and_null(spark, no_docs):
    assert L.score(no_docs).count() == 0
    got = L.score(spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3] and all(math.isfinite(r.score) for r in got)
