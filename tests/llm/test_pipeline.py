"""The pipeline, stage by stage, against plain Python on each stage's own input."""
import public_tokenizers
import sentencepiece as spm

import corpus_pipeline
from crestline.llm import decontaminate as D
from crestline.llm.storage import written
from test_jaccard import _brute
from test_text_rules import _base, _hits, _windows


def test_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    items = [(str(r.item_id), D.normal_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = _windows(items)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, sf), name)
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = len(after)
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "encoding":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for k, r in after.items() if r.text != before[k].text)
        if name == "quality_rules":
            assert not [k for k in after if _base(before[k].text)[-1]]
            assert len(after) > 0.6 * len(before)
        elif name == "near_duplicates":
            assert sorted(after) == sorted({c for _, _, c in _brute([(k, r.text) for k, r in before.items()])})
        elif name == "benchmark_decontamination":
            clean = {k for k, r in before.items() if not _hits(D.normal_words(r.text), windows)[0]}
            assert all(after[k] == before[k] for k in clean) and len(clean) < len(before)
        elif name == "personal_data":
            assert set(after) == set(before) and any(after[k].text != before[k].text for k in after)
            assert not [k for k in after if "@mail" in after[k].text and after[k].text == before[k].text]
        else:
            lib = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(r.ids == lib.encode(before[k].text, add_bos=True, add_eos=True) and r.decoded == lib.decode(r.ids) for k, r in after.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "encoding"]


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} <= names | {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= names
