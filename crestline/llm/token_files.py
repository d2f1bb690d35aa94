"""Token ids in ORC: run-length encoded ids in stripes, row indexes and Bloom filters on document ids."""
from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .arrow import data_of, lists_of, slices, strings_of, texts
from .storage import shared_path, written

#: Distinct parts of text in a worker's memo, and bytes of text whose parts are looked up once.
MEMO = 400_000
SLICE_BYTES = 6 << 20
_STATE: dict = {}


def _cuts(ends: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Byte positions where the byte-level pre-tokenizer always begins a new part, whatever stands around.

    Before a blank or line end after a visible character, before . , ! ? : ; after an ASCII letter, and before an ASCII
    letter after a line end that follows a visible character: after other white space, line ends belong to a longer part.
    A visible character is printable ASCII or one of U+00C0 to U+00FF.
    """
    letter = ((body | 32) >= 97) & ((body | 32) <= 122) & (body < 128)
    shown = (body > 32) & (body < 127)
    shown[1:] |= body[:-1] == 0xC3
    start = np.zeros(len(body), bool)
    gap = (body == 32) | (body == 10)
    start[1:] = (gap[1:] & shown[:-1]) | (np.isin(body[1:], np.frombuffer(b".,!?:;", np.uint8)) & letter[:-1])
    line = start & (body == 10)
    line[ends[:-1][ends[:-1] < len(body)]] = False
    start[1:] |= letter[1:] & line[:-1]
    start[ends[:-1][np.diff(ends) > 0]] = True
    return np.append(np.flatnonzero(start), len(body))


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is a visible Latin-1 character, else the
    next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


LETTERS = _byte_letters()


class Encoder:
    """The library's tokenizer with a memo of the parts met first, of which the frequent ones are nearly all; it starts
    anew when too many others come."""

    def __init__(self, source: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(source)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.room, self.missed = MEMO, 0

    def of(self, part: str) -> bytes:
        """Ids of a part that the memo doesn't have."""
        word = part[1:] if part[0] == " " else part
        if word.isalpha():  # one pre-token: letters after a blank at most
            found = array("i", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(LETTERS))]).tobytes()
        else:
            found = array("i", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self.memo) < self.room:
            self.memo[part] = found
        else:
            self.missed += 1
            if self.missed > 20 * self.room:
                self.memo, self.missed = {}, 0
        return found

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and ids per text; a distinct part goes through the library once in a while."""
        ends, body = data_of(strings)
        cuts = _cuts(ends, body)
        parts = strings_of(cuts, body).dictionary_encode()
        get, of = self.memo.get, self.of
        coded = [get(p) or of(p) for p in parts.dictionary.to_pylist()]
        lists = lists_of(np.frombuffer(b"".join(coded), np.int32), np.array([len(c) // 4 for c in coded], np.int64)).take(parts.indices)
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        return lists.flatten().to_numpy(), np.diff(upto[np.searchsorted(cuts, ends)])


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", end_id: int = 2) -> DataFrame:
    """Replace ``text`` by ``ids``: its byte-level ids and the end id. Null counts as empty and has the end id alone."""
    with open(tokenizer_path, encoding="utf-8") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file, not data
    columns = [c for c in df.columns if c not in (text, "ids")]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("source") != source.value:
            _STATE.update(source=source.value, encoder=Encoder(source.value))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                ids, count = _STATE["encoder"].encode(texts(part, text))
                whole = np.full(len(ids) + len(count), end_id, np.int32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                yield pa.RecordBatch.from_arrays([part[c] for c in columns] + [lists_of(whole, count + 1)], names=columns + ["ids"])

    return df.mapInArrow(run, schema)


def write(df: DataFrame, path: str, key: str = "doc_id", stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Write (key, ids) rows as ORC: run-length encoded ids, a row index each ``stride`` rows, Bloom filters on the key.

    Rows must come range-partitioned and sorted by key, so that files, stripes and row groups have disjoint key ranges
    and a lookup skips them by metadata. Files split by stripes when read.
    """
    (df.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", 0.01).option("compression", "snappy").orc(path))


def lookup(spark: SparkSession, path: str, ids: list, key: str = "doc_id") -> DataFrame:
    """Rows of some keys; the predicate reaches stripe statistics, row indexes and Bloom filters."""
    return spark.read.orc(path).where(F.col(key).isin(ids))


def write_ordered(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Encode and write in ascending key order, nulls first. One shuffle, of the texts, which are smaller than their ids.

    A column ``ordinal`` tells the order of all rows over all files, also of those with equal keys.
    """
    ordered = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("ordinal", F.monotonically_increasing_id())
    write(encode(ordered, tokenizer_path, text, end_id), path, key)


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it), n_tokens and CRC-32 of the ids.

    Starts are prefix sums in two levels: over the files, of which there are few, and inside each file, in the order in
    which the files have the rows (``ordinal``), also of equal keys. An empty folder of files gives no rows.
    """
    rows = spark.read.orc(path).select(key, "ids", "ordinal", F.col("_metadata.file_path").alias("file"))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("ordinal", T.LongType()), T.StructField("file", T.StringType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4") if len(lists) else np.zeros(0, "<u4")
            ends = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch[key], batch["ordinal"], batch["file"], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                                             names=[key, "ordinal", "file", "n_tokens", "ids_crc32"])

    light = written(rows.mapInArrow(run, schema), "token-index")
    files = light.groupBy("file").agg(F.min("ordinal").alias("least"), F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy("least")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return (light.withColumn("inside", inside).join(before, "file")
            .select(key, (F.col("before") + F.col("inside") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"))


def tokenised(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` to token files in the shared folder and return what :func:`read_index` finds there."""
    path = shared_path(docs.sparkSession, "token-files")
    write_ordered(docs, path, tokenizer_path, key, text, end_id)
    return read_index(docs.sparkSession, path, key)
