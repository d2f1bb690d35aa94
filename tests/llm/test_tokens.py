"""Encoding, decoding and token files against the libraries' own results."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm
from tokenizers import Tokenizer

from crestline.llm import pieces, token_files
from crestline.llm.storage import shared_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _rows(spark, odd_docs, docs):
    return odd_docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))


def test_ids_equal_the_library(spark, odd_docs, docs):
    lib = spm.SentencePieceProcessor(model_file=MODEL)
    df = pieces.decode(pieces.encode(_rows(spark, odd_docs, docs), MODEL), MODEL)
    for row in df.collect():
        text = row["text"] or ""
        assert row["ids"] == lib.encode(text, add_bos=True, add_eos=True)
        assert row["decoded"] == lib.decode(row["ids"])


def test_spans_cover_the_text(spark, odd_docs):
    for row in pieces.encode(odd_docs, MODEL).collect():
        raw = (row["text"] or "").encode()
        spans = list(zip(row["begins"], row["ends"]))
        assert b"".join(raw[a:b] for a, b in spans) == raw
        assert all(a <= b for a, b in spans) and sorted(spans) == spans


def test_query_digests(spark, odd_docs, no_docs):
    lib = spm.SentencePieceProcessor(model_file=MODEL)
    source = odd_docs.select("doc_id", "text")
    digests = {tuple(r) for r in pieces.digests(source, MODEL).collect()}
    for row in pieces.encode(source, MODEL, decoded="back").collect():
        assert row.back == lib.decode(row.ids)
        assert (row.doc_id, len(row.ids), hashlib.sha256(np.array(row.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(row.back.encode()).hexdigest()) in digests
    df = pieces.digest_ids(pieces.encode(odd_docs.select("doc_id", "text"), MODEL, spans=False))
    for row in df.collect():
        ids = lib.encode(row["text"] or "", add_bos=True, add_eos=True)
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert pieces.encode(no_docs, MODEL).count() == 0 and "n_words" in pieces.encode(odd_docs, MODEL).columns


def test_compiled_map_equals_the_library():
    """Longest-prefix normalisation through real compiled maps, built into the library."""
    from sentencepiece import sentencepiece_model_pb2 as spb
    texts = ["ﬁne ㌔ Å é ｱｲ １２  ", "  two  blanks", "plain", "", " 　x", "한국어 ½ ㎏"]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        try:
            lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        except Exception:
            pytest.skip("no built-in rules")
        blob = lib.serialized_model_proto()
        model = pieces.Model.__new__(pieces.Model)
        proto = spb.ModelProto()
        proto.ParseFromString(blob)
        model.map = pieces.character_map(proto.normalizer_spec.precompiled_charsmap)
        assert len(model.map) > 1000
        model.users, model.heads, model.longest = set(), {k[:1] for k in model.map}, max(map(len, model.map))
        model.dummy = model.squeeze = model.escape = True
        model.suffix = False
        for text in texts:
            body, align = model.normalise(text.encode())
            assert body.decode() == lib.normalize(text)
            assert len(align) == len(body) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_token_files(spark, odd_docs, docs, no_docs):
    rows = _rows(spark, odd_docs, docs)
    lib = Tokenizer.from_file(BYTES)
    got = sorted((tuple(r) for r in token_files.tokenised(rows, BYTES).collect()), key=lambda r: r[1])
    want, start = {}, 0
    for r in rows.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for key, at, n, crc in got:
        assert at == start and (n, crc) in want[key]
        want[key].remove((n, crc))
        start += n
    assert not any(want.values())
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda k: (k is not None, k))
    assert token_files.tokenised(no_docs, BYTES).count() == 0


def test_parts_equal_the_library_on_random_text():
    """White space, letters and marks in any order, paragraph breaks included."""
    import random
    import pyarrow as pa
    rng = random.Random(4)
    signs = ["a", "Bc", " ", "\n", "\n\n", "\t", "\r", ".", ",", "'s", "7", "é", "\u00a0", "\u3000", "你", "<"]
    lib = Tokenizer.from_file(BYTES)
    rows = ["a\n\nb", "a\nb", "\nb", "a \nb"] + ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(4000)]
    with open(BYTES, encoding="utf-8") as file:
        ids, count = token_files.Encoder(file.read()).encode(pa.array(rows, pa.string()))
    upto = np.concatenate([[0], np.cumsum(count)])
    for text, a, b in zip(rows, upto[:-1], upto[1:]):
        assert ids[a:b].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_starts_follow_the_file(spark):
    """Rows with equal keys start where the file has them."""
    path = shared_path(spark, "equal-keys")
    df = spark.createDataFrame([(1, "word " * n) for n in (5, 2, 9, 1)] + [(None, "x"), (None, "longer text here")], "doc_id long, text string")
    token_files.write_ordered(df.coalesce(1), path, BYTES)
    stored = [r for r in spark.read.orc(path).orderBy("ordinal").collect()]
    index = token_files.read_index(spark, path).orderBy("start").collect()
    start = 0
    for r, i in zip(stored, index):
        assert (i.doc_id, i.start, i.n_tokens) == (r.doc_id, start, len(r.ids))
        start += len(r.ids)


def test_lookup_prunes(spark, docs):
    path = shared_path(spark, "lookup")
    token_files.write_ordered(docs, path, BYTES)
    found = token_files.lookup(spark, path, [3, 7])
    assert sorted(r.doc_id for r in found.collect()) == [3, 7]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()
