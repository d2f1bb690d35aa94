"""Language identification: sums over segmentations by brute force, held-out accuracy, odd input."""
import math

import numpy as np
import public_tokenizers
import pytest

from crestline.llm import language_id as L

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    """All ways to cut ``word`` into pieces; a character that is no piece may stand alone as unknown."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        head = word[:n]
        i = pieces.get(head, len(pieces) if n == 1 else None)
        if i is not None:
            out += [[i, *rest] for rest in segmentations(word[n:], pieces)]
    return out


def test_forward_and_expected_counts_equal_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "▁aba", "c"]
    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(len(pieces) + 1), 3).T)
    words = ["a", "ab", "aba", "abab", "bazab", "zz", "ccc", "x" * 9]
    lattice, index = L.Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    got = lattice.forward(words, table)
    into = np.zeros(table.shape)
    language, times = np.array([i % 3 for i in range(len(words))]), np.arange(1.0, len(words) + 1)
    lattice.expected(words, language, times, table, into)
    want = np.zeros(table.shape)
    for w, word in enumerate(words):
        ways = segmentations(L.MARK + word, index)
        for k in range(3):
            total = math.fsum(math.exp(sum(table[i, k] for i in way)) for way in ways)
            assert got[w, k] == pytest.approx(math.log(total), rel=1e-9)
            if k == language[w]:
                for way in ways:
                    for i in way:
                        want[i, k] += times[w] * math.exp(sum(table[j, k] for j in way)) / total
    assert np.allclose(into, want)


def test_long_words_do_not_underflow():
    lattice = L.Lattice(["▁", "a"])
    table = np.log(np.array([[0.5, 0.2], [0.4, 0.3], [0.1, 0.5]]))
    got = lattice.forward(["a" * 5000, "z"], table)
    assert got[0] == pytest.approx(table[0] + 5000 * table[1]) and got[1] == pytest.approx(table[0] + table[2])


def test_text_scores_by_brute_force(spark):
    """The whole chain on a few texts: learned counts, priors, products over words, shares."""
    rows = [(1, "aa ab, AB!", "x"), (2, "bb ba 12 b", "y"), (3, "ab", "x"), (4, None, "x"), (5, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, MODEL)
    assert model.languages == ["x", "y"] and np.exp(model.priors) == pytest.approx([0.75, 0.25])
    assert np.exp(model.table).sum(axis=0) == pytest.approx([1, 1])
    index = {p: i for i, p in enumerate(model.pieces)}
    for r in L.predict(df, model).collect():
        found = [w for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = [model.priors[k] + sum(math.log(math.fsum(math.exp(sum(model.table[i, k] for i in way)) for way in segmentations(L.MARK + w, index))) for w in found)
                 for k in range(2)]
        share = 1 / (1 + math.exp(min(total) - max(total)))
        assert r.lang_pred == model.languages[int(np.argmax(total))] and r.score == pytest.approx(share, abs=2e-6)


def test_held_out_accuracy(spark, docs):
    rows = L.identify(docs, MODEL).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    judged = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang and len(r.text or "") > 40]
    assert len(judged) > 20 and sum(judged) >= 0.95 * len(judged)


def test_only_training_rows_teach(spark, docs):
    """Texts and languages of held-out rows change nothing, nor do source and id."""
    from pyspark.sql import functions as F
    one = {r.doc_id: tuple(r) for r in L.identify(docs, MODEL).collect()}
    hidden = L.held_out("doc_id")
    spoilt = docs.withColumn("lang", F.when(hidden, F.lit("qq")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert {r.doc_id: tuple(r) for r in L.identify(spoilt, MODEL).collect()} == one


def test_odd_rows(spark, odd_docs, no_docs):
    got = L.identify(odd_docs.withColumn("lang_pred", odd_docs.source), MODEL).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert by[7] == by[8]
    for key, found in by.items():
        assert (("und", 0.0) in found) == (not any(c.isalpha() for c in texts[key] or "")), key
    assert L.identify(no_docs, MODEL).collect() == []
    unnamed = odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).where("doc_id = 4")
    assert [r.lang_pred for r in L.identify(unnamed, MODEL).collect()] == ["und"]
