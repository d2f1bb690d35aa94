"""Substring deduplication by sliding spans of sentences."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import slices

#: A sentence ends at a mark with white space behind it, or at a line end. Its white space belongs to it.
SENTENCE = re.compile(r"[^\n]*?(?:[.!?…]+[\"'”»)\]]*[^\S\n]+|\n+|$)|[^\n]+$")
SENTENCES, WORDS = 2, 20


def sentences(text: str) -> list[str]:
    """Pieces of the text, sentence by sentence; joined they give the text."""
    return [m[0] for m in SENTENCE.finditer(text) if m[0]]


def runs(parts: list[str], least: int = SENTENCES, words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first, end, hash) of the shortest runs with ``least`` sentences and ``words`` words from each sentence on and up to
    each sentence, in order of their starts.

    Together they cover each sentence of any longer run from inside: by the run from the sentence on or, near the end, by
    the run up to the end. Which runs are taken follows from their words alone. Runs compare by their words after lower-casing; pieces without words do not count as sentences.
    """
    split = [p.lower().split() for p in parts]
    full = [i for i, w in enumerate(split) if w]
    marks = [xxhash.xxh3_128_digest(" ".join(split[i])) for i in full]
    size = np.concatenate([[0], np.cumsum([len(split[i]) for i in full])]).astype(np.int64)
    place = np.arange(len(full) + 1)
    ends = np.maximum(np.searchsorted(size, size[:-1] + words), place[:-1] + least)
    starts = np.minimum(np.searchsorted(size, size[1:] - words, side="right") - 1, place[1:] - least)
    on = [(k, end) for k, end in enumerate(ends.tolist()) if end <= len(full)]
    upto = [(k, end) for end, k in enumerate(starts.tolist(), 1) if k >= 0]
    for k, end in sorted({*on, *upto}):
        yield full[k], full[end - 1] + 1, xxhash.xxh3_128_digest(b"".join(marks[k:end]))


def spans(docs: DataFrame, key: str, text: str, least: int, words: int) -> DataFrame:
    """All runs of all documents: hash halves h1 and h2, place (key and a hash of its text), first and end."""
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("key", docs.schema[key].dataType),
                           T.StructField("own", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                marks, counts, own, first, end = [], [], [], [], []
                for body in part[text].to_pylist():
                    found = list(runs(sentences(body or ""), least, words))
                    counts.append(len(found))
                    own.append(xxhash.xxh3_64_intdigest(body or "") - (1 << 63))
                    marks += [f[2] for f in found]
                    first += [f[0] for f in found]
                    end += [f[1] for f in found]
                halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), part[key].take(rows), pa.array(own, pa.int64()).take(rows),
                                                  pa.array(first, pa.int32()), pa.array(end, pa.int32())], schema=pa.schema(
                    [("h1", pa.int64()), ("h2", pa.int64()), ("key", part[key].type), ("own", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))

    return docs.select(key, text).mapInArrow(run, schema)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Documents without the sentences that a repeated run covers, unless it is the run's first occurrence.

    The first occurrence is the one with the smallest key, then place in the text. Runs inside one document count too.
    Appends n_sentences and n_removed; ``text`` is what remains, and n_chars, where there is one, follows it. Null texts
    stay null and have no sentences; a null key comes before all others; rows equal in key and text count as one document.
    Hashes are pre-aggregated before they are shuffled, and occurrences join on them with a side that has one row per
    repeated hash, so that a frequent run can be split.
    """
    every = spans(docs, key, text, least, words)
    place = F.struct(F.col("key").isNotNull().alias("has"), "key", "own", "first")
    repeated = every.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.count("*").alias("n")).where("n > 1")
    again = every.join(repeated.select("h1", "h2", "low"), ["h1", "h2"]).where(place != F.col("low"))
    covered = again.groupBy("key", "own").agg(F.collect_set(F.struct("first", "end")).alias("covered")) \
        .select(F.col("key").alias("_key"), F.col("own").alias("_own"), "covered")
    base = docs.drop("n_sentences", "n_removed")
    marked = _with_hash(base, text)
    joined = marked.join(covered, marked[key].eqNullSafe(covered["_key"]) & (F.col("_hash") == F.col("_own")), "left") \
        .select(*[F.col(f"`{c}`") for c in base.columns], "covered")
    columns = base.columns
    schema = T.StructType(list(base.schema.fields) + [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, n, gone = [], [], []
            for body, cover in zip(batch[text].to_pylist(), batch["covered"].to_pylist()):
                parts = sentences(body or "")
                drop = {i for c in cover or () for i in range(c["first"], c["end"])}
                bodies.append(body if not drop else "".join(p for i, p in enumerate(parts) if i not in drop))
                n.append(sum(not p.isspace() for p in parts))
                gone.append(sum(i in drop and not p.isspace() for i, p in enumerate(parts)))
            arrays = []
            for c in columns:
                column = batch[c]
                if c == text:
                    column = pa.array(bodies, column.type)
                elif c == "n_chars":
                    column = pa.array([len(b) if g else v for b, g, v in zip(bodies, gone, column.to_pylist())], column.type)
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def _with_hash(docs: DataFrame, text: str) -> DataFrame:
    """Append _hash, the same hash of the text that the runs carry."""
    schema = T.StructType(list(docs.schema.fields) + [T.StructField("_hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [xxhash.xxh3_64_intdigest(b or "") - (1 << 63) for b in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)
