"""Alignment of tokenizers against plain Python over whole texts."""
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import random
import sentencepiece as spm
from tokenizers import Tokenizer

from crestline.llm import alignment
from crestline.llm.token_files import LETTERS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, spm.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Rows of figures by comparing every pair of tokens of every group."""
    a, b = libraries
    back = {letter: byte for byte, letter in LETTERS.items()}
    docs, counts = [], Counter()
    for text in texts:
        links, groups, n = [], [], (0, 0)
        if text:
            ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb):
                n, x, y, at, bt, left, right = (len(ta), len(tb)), 0, 0, 0, 0, [], []
                spans = []
                for tokens in (ta, tb):
                    at, out = 0, []
                    for i, raw in tokens:
                        out.append((i, at, at + len(raw)))
                        at += len(raw)
                    spans.append(out)
                common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                start = 0
                for end in common:
                    left = [t for t in spans[0][x:] if t[2] <= end]
                    right = [t for t in spans[1][y:] if t[2] <= end]
                    x, y = x + len(left), y + len(right)
                    groups.append(",".join(str(t[0]) for t in left) + "|" + ",".join(str(t[0]) for t in right))
                    links += [(p[0], q[0]) for p in left for q in right if p[1] < q[2] and q[1] < p[2]]
                    start = end
        counts.update(links)
        docs.append((n, groups, links))
    top = Counter()
    for (p, q), c in counts.items():
        top[q] = max(top[q], c)
    return [(*n, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n, groups, links in docs]


def check(spark, texts, libraries):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, key int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, A, B).collect()}
    want = brute(texts, libraries)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i] and texts[i][:80])


def texts_at_random(n, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "word", "the", " ", "  ", "\n", "\n\n", "\r\n", "\t", ".", ",", "é", "ß", "你好", "😀", "'s", "42", " ", "　", "<0x41>", "<|endoftext|>", "x" * 30]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_whole_result(spark, odd_docs, docs, libraries):
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in docs.select("text").limit(40).collect()]
    check(spark, texts + texts_at_random(120, 1), libraries)


def test_fragments_of_long_documents(spark, odd_docs, docs, libraries, monkeypatch):
    """The same result when nearly every document is cut into segments and byte ranges that split tokens and groups."""
    for name, value in (("LONG", 60), ("CHUNK", 11), ("FAN", 5)):
        monkeypatch.setattr(alignment, name, value)
    texts = [t[:3000] if t else t for t in (r.text for r in odd_docs.collect())] + [r.text[:900] for r in docs.select("text").limit(12).collect()]
    check(spark, texts + texts_at_random(60, 2), libraries)


def test_composition_is_associative(libraries):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        pair = alignment.Pair(a.read(), b.read())
    import numpy as np
    import pyarrow as pa
    for text in texts_at_random(20, 3):
        ends, body = alignment.data_of(pa.array([" " + text], pa.string()))
        coded = alignment.strings_of(pair.cuts(ends, body), body).dictionary_encode()
        good, stream, a_n, b_n = pair.tokens(coded.dictionary)
        if not good.all():
            continue
        size = alignment.pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = alignment.expand(stream, a_n, b_n, coded.indices.to_numpy(), size)
        cuts = [0, *sorted(random.Random(text).sample(range(1, len(body)), min(3, len(body) - 1))), len(body)]
        names = alignment.T._parse_datatype_string(alignment.PIECE).names

        def fold(order):
            parts, closed = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = [dict(zip(names, r)) for r in alignment.fragment(pair, 0, a, whole.cut(a, b))] if len(whole.cut(a, b).a) + len(whole.cut(a, b).b) else []
                parts += [r for r in rows if r["kind"] == alignment.OPEN]
                closed += [r for r in rows if r["kind"] == alignment.CLOSED]
            while len(parts) > 1:
                i = 0 if order == "left" else len(parts) - 2
                rows = [dict(zip(names, r)) for r in alignment.compose(pair, parts[i:i + 2])]
                closed += [r for r in rows if r["kind"] == alignment.CLOSED]
                parts[i:i + 2] = [r for r in rows if r["kind"] == alignment.OPEN]
            return [list(parts[0][f"p_{n}"]) for n in alignment.SIDES], ";".join(r["shown"] for r in sorted(closed, key=lambda r: r["at"]))

        assert fold("left") == fold("right")


def test_edges(spark, no_docs, libraries):
    assert alignment.align(no_docs, A, B).collect() == []
    df = spark.createDataFrame([("k", None), ("k", "same"), ("k", "same"), (None, "▁ lost")], "id string, body string")
    rows = sorted(tuple(r)[:5] for r in alignment.align(df, A, B, "id", "body").where("id IS NOT NULL").collect())
    assert rows[0] == ("k", 0, 0, 0, 0) and rows[1] == rows[2] and rows[1][1] > 0
    assert [tuple(r)[1:5] for r in alignment.align(df, A, B, "id", "body").where("id IS NULL").collect()] == [(0, 0, 0, 0)]
