"""Alignment of two tokenizers: groups between common token ends, links between overlapping tokens.

A stretch of a document's bytes is a fragment: tokens up to its first common end (open prefix), groups closed inside it,
and tokens behind its last common end (open suffix); without a common end all of it is open. Fragments of neighbouring
stretches compose by closing the group between suffix and prefix, and this is associative. So documents above ``LONG``
bytes are cut into segments, tokenized apart in many tasks, cut again into byte ranges of ``CHUNK``, and composed in a tree
of ``FAN`` at a time, by keys, so that no task holds a whole document. Shorter ones are composed in the task that reads
them, from parts between places where either tokenizer always begins anew; a part met again is not aligned again.

A link is a stretch between two neighbouring ends of either tokenizer, as each such stretch lies in one token of both. How
often an id pair is linked in the corpus is an aggregate over blocks of documents; each block gets back the counts of its
own distinct pairs only.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import data_of, lists_of, slices, strings_of, texts
from .pieces import MARK, Model
from .storage import written
from .token_files import LETTERS, Encoder

#: Bytes of text in a block of documents.
BLOCK_BYTES = 2 << 20
#: Distinct parts that a worker keeps between blocks, per tokenizer.
ROOM = 150_000
#: Documents above this many bytes are spread over tasks, in segments of about as many.
LONG = 1 << 16
#: Bytes of a fragment of a long document, and fragments composed at once.
CHUNK, FAN = 1 << 13, 8
#: An id pair is one number: the first tokenizer's id times this, plus the second's.
WIDE = 1 << 32


def pack(values: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(values) else b"")


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = pa.decompress(blob[8:], 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Stream:
    """Tokens of both tokenizers over the same bytes: ids and ends of A, ids and ends of B."""

    __slots__ = ("a", "a_end", "b", "b_end")

    def __init__(self, a, a_end, b, b_end):
        self.a, self.a_end, self.b, self.b_end = a, a_end, b, b_end

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Id pair and end of every link, in order, for a stream whose two sides end at the same byte."""
        ends = np.union1d(self.a_end, self.b_end)
        a, b = self.a[np.searchsorted(self.a_end, ends)], self.b[np.searchsorted(self.b_end, ends)]
        return a.astype(np.int64) * WIDE + b, ends

    def closes(self) -> np.ndarray:
        """Ends that both sides share."""
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)

    def cut(self, after: int, upto: int) -> "Stream":
        i, j = np.searchsorted(self.a_end, [after, upto], "right"), np.searchsorted(self.b_end, [after, upto], "right")
        return Stream(self.a[i[0]:i[1]], self.a_end[i[0]:i[1]], self.b[j[0]:j[1]], self.b_end[j[0]:j[1]])

    def __add__(self, other: "Stream") -> "Stream":
        return Stream(*[np.concatenate([getattr(self, n), getattr(other, n)]) for n in self.__slots__])


class Pair:
    """Both tokenizers with tables of their tokens' bytes."""

    def __init__(self, a_source: str, b_blob: bytes):
        self.a = Encoder(a_source)
        self.a.tokenizer.encode_special_tokens = True
        self.b = Model(b_blob)
        self.a.room = self.b.room = ROOM
        pieces = [self.b.segment.id_to_piece(i) for i in range(self.b.segment.get_piece_size())]
        if not (self.b.plain and self.b.apart and self.b.dummy):
            raise ValueError("the second model must keep white space, add a blank in front and fall back to bytes")
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.segment.is_byte(i) else p.encode().replace(MARK, b" ") for i, p in enumerate(pieces)], pa.binary())
        back = {letter: byte for byte, letter in LETTERS.items()}
        named = self.a.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.a_bytes = pa.array(table, pa.binary())
        self.lines = not any(b"\n" in x for i, x in enumerate(self.b_bytes.to_pylist()) if not self.b.segment.is_byte(i))
        count = max(len(table), len(pieces))
        self.names = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(count)], pa.string())
        self.count = count

    def cuts(self, ends: np.ndarray, body: np.ndarray) -> np.ndarray:
        """Bytes where either tokenizer begins anew, whatever stands around: a blank or line end behind a visible
        character, and a visible one behind such a line end."""
        ascii_shown = (body > 32) & (body < 127)
        shown = ascii_shown.copy()
        shown[1:] |= (body[:-1] == 0xC3) & (body[1:] >= 0x80)
        start = np.zeros(len(body), bool)
        start[1:] = (body[1:] == 32) & shown[:-1]
        if self.lines:
            line = np.zeros(len(body), bool)
            line[1:] = (body[1:] == 10) & shown[:-1]
            line[ends[:-1]] = False
            start |= line
            start[1:] |= ascii_shown[1:] & line[:-1]
        start[ends[:-1]] = True
        return np.append(np.flatnonzero(start), len(body))

    def tokens(self, distinct: pa.Array) -> tuple[np.ndarray, Stream, np.ndarray, np.ndarray]:
        """Of distinct parts: which are kept by both tokenizers, the stream of all kept ones put behind each other, and
        how many tokens of A and of B each has (none where a part is not kept)."""
        parts = distinct.to_pylist()
        get, of = self.a.memo.get, self.a.of
        coded = [get(p) or of(p) for p in parts]
        a_n = np.array([len(c) // 4 for c in coded], np.int64)
        a = np.frombuffer(b"".join(coded), np.int32)
        marked = pc.replace_substring(distinct, " ", MARK.decode()).to_pylist()
        lists = self.b.coded(marked)
        b_n, b = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
        ends, body = data_of(distinct)
        good = np.ones(len(parts), bool)
        for table, ids, n in ((self.a_bytes, a, a_n), (self.b_bytes, b, b_n)):
            raw = table.take(pa.array(ids))
            size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            same = np.diff(upto) == np.diff(ends)
            good &= same
            flat = data_of(_as_text(raw))[1]
            if same.all():
                wrong = flat != body
                good &= ~np.logical_or.reduceat(np.append(wrong, False), ends[:-1])[:len(parts)] if len(parts) else good
            else:
                for i in np.flatnonzero(same):
                    good[i] &= bytes(flat[upto[i]:upto[i + 1]]) == bytes(body[ends[i]:ends[i + 1]])
        keep_a, keep_b = np.repeat(good, a_n), np.repeat(good, b_n)
        a, b, a_n, b_n = a[keep_a], b[keep_b], np.where(good, a_n, 0), np.where(good, b_n, 0)
        a_end = np.cumsum(pc.binary_length(self.a_bytes.take(pa.array(a))).to_numpy(zero_copy_only=False).astype(np.int64))
        b_end = np.cumsum(pc.binary_length(self.b_bytes.take(pa.array(b))).to_numpy(zero_copy_only=False).astype(np.int64))
        return good, Stream(a, a_end, b, b_end), a_n, b_n

    def named(self, stream: Stream, closes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts ``a1,a2|b1;`` of all groups in a row as one string per token, and the groups of A and of B tokens."""
        g_a, g_b = np.searchsorted(closes, stream.a_end), np.searchsorted(closes, stream.b_end)
        n_a, n_b = np.bincount(g_a, minlength=len(closes)), np.bincount(g_b, minlength=len(closes))
        at_a = np.arange(len(g_a)) + (np.cumsum(n_b) - n_b)[g_a]
        at_b = np.arange(len(g_b)) + np.cumsum(n_a)[g_b]
        index = np.empty(len(g_a) + len(g_b), np.int64)
        last_a, last_b = np.append(g_a[1:] != g_a[:-1], True)[:len(g_a)], np.append(g_b[1:] != g_b[:-1], True)[:len(g_b)]
        index[at_a] = stream.a + self.count * last_a
        index[at_b] = stream.b + 2 * self.count * last_b
        return self.names.take(pa.array(index)), g_a, g_b


def _as_text(raw: pa.Array) -> pa.Array:
    """A binary array seen as a string array, without a look at its bytes."""
    return pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2], None, 0, raw.offset)


def expand(stream: Stream, a_n: np.ndarray, b_n: np.ndarray, which: np.ndarray, size: np.ndarray) -> Stream:
    """The stream of parts ``which`` in a row, from the stream of distinct parts and their numbers of tokens."""
    start = np.concatenate([[0], np.cumsum(size)])
    shift = np.concatenate([[0], np.cumsum(size[which])])[:-1] - start[which]
    out = []
    for ids, ends, n in ((stream.a, stream.a_end, a_n), (stream.b, stream.b_end, b_n)):
        first, count = np.cumsum(n) - n, n[which]
        at = np.arange(count.sum()) + np.repeat(first[which] - (np.cumsum(count) - count), count)
        out += [ids[at], ends[at] + np.repeat(shift, count)]
    return Stream(*out)


_PAIRS: dict = {}


def _pair(a_source: str, b_blob: bytes) -> Pair:
    if _PAIRS.get("key") != (hash(a_source), hash(b_blob)):
        _PAIRS.clear()
        _PAIRS.update(key=(hash(a_source), hash(b_blob)), pair=Pair(a_source, b_blob))
    return _PAIRS["pair"]


def _sources(df: DataFrame, a_path: str, b_path: str):
    """Both vocabulary files, read by the driver and sent to the tasks; their size does not depend on the data."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return df.sparkSession.sparkContext.broadcast((a.read(), b.read()))


BLOCK = "block long, key array<{kind}>, figures array<array<bigint>>, sha array<string>, pairs array<bigint>, times array<bigint>, links binary, link_ends binary, parts binary, part_ends binary"


def short_blocks(df: DataFrame, sources, key: str, text: str) -> DataFrame:
    """Documents by blocks: their figures and digests, and the links of their distinct parts."""
    schema = T._parse_datatype_string(BLOCK.format(kind=df.schema[key].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*sources.value)
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                source = texts(part, text)
                filled = pc.greater(pc.binary_length(source), 0).to_numpy(zero_copy_only=False)
                ends, body = data_of(pc.binary_join_element_wise(" ", source, ""))
                cuts = pair.cuts(ends, body)
                coded = strings_of(cuts, body).dictionary_encode()
                del body
                which = coded.indices.to_numpy()
                of_doc = np.searchsorted(cuts, ends)
                good, stream, a_n, b_n = pair.tokens(coded.dictionary)
                closes = stream.closes()
                links, link_end = stream.links()
                # tokens, groups, links and text of each distinct part; a part ends where a group and a link do
                part_end = stream.a_end[np.cumsum(a_n) - 1] if len(stream.a) else np.zeros(len(a_n), np.int64)
                part_end = np.where(np.cumsum(a_n) > 0, part_end, 0)
                groups = np.diff(np.concatenate([[0], np.searchsorted(closes, part_end, "right")]))
                link_at = np.searchsorted(link_end, part_end, "right")
                n_links = np.diff(np.concatenate([[0], link_at]))
                names, _, _ = pair.named(stream, closes)
                chars, name_body = data_of(names)
                text_at = chars[np.concatenate([[0], np.cumsum(a_n + b_n)])]
                part_texts = strings_of(text_at, name_body)
                sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[which])])[of_doc])
                keep = filled & (sums(~good) == 0)
                figures = np.stack([np.where(keep, sums(v), 0) for v in (a_n, b_n, groups, n_links)], axis=1)
                shown_at, shown = data_of(part_texts.take(coded.indices))
                shown_at, view = shown_at[of_doc], memoryview(np.ascontiguousarray(shown))
                sha = [hashlib.sha256(view[s:e - 1]).hexdigest() if k else "" for k, s, e in zip(keep.tolist(), shown_at[:-1].tolist(), shown_at[1:].tolist())]
                # only parts of documents that count are linked
                which = which[np.repeat(keep, np.diff(of_doc))]
                doc_parts = np.where(keep, np.diff(of_doc), 0)
                used = np.bincount(which, minlength=len(good))
                pairs, local = np.unique(links, return_inverse=True)
                times = np.bincount(local, weights=np.repeat(used, n_links), minlength=len(pairs)).astype(np.int64) if len(links) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part["_uid"][0].as_py()], pa.int64()), lists_of_array(part[key]), lists_of_array(lists_of(figures.ravel(), np.full(len(figures), 4))),
                    lists_of_array(pa.array(sha, pa.string())), lists_of_array(pa.array(pairs)), lists_of_array(pa.array(times)),
                    *[pa.array([pack(v)], pa.binary()) for v in (local, link_at, which, np.cumsum(doc_parts))]], names=schema.names)
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def lists_of_array(values: pa.Array) -> pa.Array:
    """All values as one list."""
    values = pa.concat_arrays([values])
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def rated_blocks(blocks: DataFrame, rated: DataFrame, kind: T.DataType) -> DataFrame:
    """(key, figures, n_best, count_sum, sha) of every item of the blocks; ``rated`` has the count of every pair."""
    pairs = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    mine = pairs.join(rated, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    rows = blocks.drop("pairs", "times").join(mine, "block", "left")
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(n, T.LongType()) for n in (*FIGURES, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch[n][i] for n in batch.schema.names}
                links, link_at, which, part_at = (unpack(row[n].as_py()) for n in ("links", "link_ends", "parts", "part_ends"))
                found = row["found"].values
                count, best = np.zeros(links.max() + 1 if len(links) else 1, np.int64), np.zeros(links.max() + 1 if len(links) else 1, np.int64)
                if found is not None:
                    at, times, top = (column.to_numpy(zero_copy_only=False) for column in found.flatten())
                    count[at], best[at] = times, top
                per_doc = []
                for values in (best, count):
                    per_part = np.diff(np.concatenate([[0], np.cumsum(values[links])])[np.concatenate([[0], link_at])])
                    per_doc.append(np.diff(np.concatenate([[0], np.cumsum(per_part[which])])[np.concatenate([[0], part_at])]))
                figures = row["figures"].values.flatten().to_numpy().reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([row["key"].values, *[pa.array(np.ascontiguousarray(figures[:, k])) for k in range(4)],
                                                  pa.array(per_doc[0]), pa.array(per_doc[1]), row["sha"].values], names=schema.names)

    return rows.mapInArrow(run, schema)


# --- documents above the limit -------------------------------------------------------------

SIDES = ("a", "a_end", "b", "b_end")
PIECE = ("uid long, kind int, at long, split boolean, suffix_at long, " + ", ".join(f"{p}_{n} array<bigint>" for p in ("p", "s") for n in SIDES)
         + ", n_a long, n_b long, n_groups long, n_links long, shown string, pairs array<bigint>, times array<bigint>")
#: Kinds of rows: a fragment's open sides, closed groups, and the mark of a document that a tokenizer does not keep.
OPEN, CLOSED, BAD = 0, 1, 2
NONE = Stream(*[np.zeros(0, np.int64)] * 4)


def _open(uid: int, at: int, split: bool, suffix_at: int, prefix: Stream, suffix: Stream) -> tuple:
    return (uid, OPEN, at, split, suffix_at, *[getattr(x, n) for x in (prefix, suffix) for n in SIDES], 0, 0, 0, 0, None, None, None)


def _closed(pair: Pair, uid: int, at: int, stream: Stream) -> tuple:
    """A row of whole groups: their figures, text and links."""
    names, _, _ = pair.named(stream, closes := stream.closes())
    links, _ = stream.links()
    pairs, times = np.unique(links, return_counts=True)
    return (uid, CLOSED, at, None, None, *[None] * 8, len(stream.a), len(stream.b), len(closes), len(links), "".join(names.to_pylist())[:-1], pairs, times)


def fragment(pair: Pair, uid: int, at: int, stream: Stream) -> Iterator[tuple]:
    """Rows of one stretch: its open sides, and the groups closed between them."""
    closes = stream.closes()
    if not len(closes):
        yield _open(uid, at, False, at, stream, NONE)
        return
    first, last = int(closes[0]), int(closes[-1])
    yield _open(uid, at, True, last, stream.cut(-1, first), stream.cut(last, 1 << 62))
    if last > first:
        yield _closed(pair, uid, first, stream.cut(first, last))


def compose(pair: Pair, rows: list[dict]) -> Iterator[tuple]:
    """Rows of neighbouring fragments, in order, as one fragment and the groups closed at their seams."""
    side = lambda r, p: Stream(*[np.asarray(r[f"{p}_{n}"], np.int64) for n in SIDES])
    uid, at = rows[0]["uid"], rows[0]["at"]
    split, suffix_at, prefix, suffix = rows[0]["split"], rows[0]["suffix_at"], side(rows[0], "p"), side(rows[0], "s")
    for r in rows[1:]:
        if split and r["split"]:
            yield _closed(pair, uid, suffix_at, suffix + side(r, "p"))
            suffix_at, suffix = r["suffix_at"], side(r, "s")
        elif split:
            suffix = suffix + side(r, "p")
        else:
            prefix = prefix + side(r, "p")
            if r["split"]:
                split, suffix_at, suffix = True, r["suffix_at"], side(r, "s")
    yield _open(uid, at, split, suffix_at, prefix, suffix)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


def long_pieces(df: DataFrame, sources, text: str) -> tuple[DataFrame, DataFrame]:
    """Closed groups (PIECE) of all given documents that both tokenizers keep, and the ids of the others."""
    schema = T._parse_datatype_string(PIECE)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*sources.value)
        for batch in batches:
            for part in slices(batch, text, LONG):
                marked = pc.binary_join_element_wise(" ", texts(part, text), "")
                for uid, one in zip(part["_uid"].to_pylist(), marked):
                    ends, body = data_of(pa.array([one.as_py()], pa.string()))
                    cuts = pair.cuts(ends, body)
                    marks = np.unique(np.concatenate([[0], cuts[np.minimum(np.searchsorted(cuts, np.arange(LONG, len(body), LONG)), len(cuts) - 1)], [len(body)]]))
                    for a, b in zip(marks[:-1].tolist(), marks[1:].tolist()):
                        yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([a], pa.int64()), pa.array([bytes(body[a:b]).decode()], pa.string())],
                                                         names=["uid", "start", "segment"])

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(*sources.value)
        for frame in batches:
            for uid, start, segment in frame.itertuples(index=False):
                ends, body = data_of(pa.array([segment], pa.string()))
                cuts = pair.cuts(ends, body)
                coded = strings_of(cuts, body).dictionary_encode()
                good, stream, a_n, b_n = pair.tokens(coded.dictionary)
                if not good.all():
                    yield _frame([(uid, BAD, start, *[None] * (len(schema) - 3))], schema.names)
                    continue
                size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
                whole = expand(stream, a_n, b_n, coded.indices.to_numpy(), size)
                whole = Stream(whole.a.astype(np.int64), whole.a_end + start, whole.b.astype(np.int64), whole.b_end + start)
                # byte ranges of the document, whatever tokens or segments they cut; a token belongs where it ends
                stop, rows = start + len(body), []
                edges = [start, *range((start // CHUNK + 1) * CHUNK, stop, CHUNK), stop]
                for a, b in zip(edges[:-1], edges[1:]):
                    part = whole.cut(a, b)
                    if len(part.a) or len(part.b):
                        rows += fragment(pair, uid, a, part)
                yield _frame(rows, schema.names)

    def composed(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(compose(_pair(*sources.value), frame.sort_values("at").to_dict("records")))
        return _frame(rows, schema.names)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(*sources.value)
        for frame in batches:  # a document begins and ends where both tokenizers do: what is open is one group
            yield _frame([_closed(pair, r["uid"], r["at"], Stream(*[np.asarray(r[f"p_{n}"], np.int64) for n in SIDES])) for r in frame.to_dict("records")], schema.names)

    cut = df.mapInArrow(segments, "uid long, start long, segment string").repartition("uid", "start")
    rows = written(cut.mapInPandas(fragments, schema), "alignment-fragments", "lz4")
    bad = rows.where(F.col("kind") == BAD).select("uid").distinct()
    rows = rows.join(bad, "uid", "left_anti")
    closed, parts = [rows.where(F.col("kind") == CLOSED)], rows.where(F.col("kind") == OPEN)
    last = parts.agg(F.max("at")).first()[0] or 0
    level = 1
    while CHUNK * FAN ** (level - 1) <= last:
        node = F.floor(F.col("at") / (CHUNK * FAN ** level))
        rows = written(parts.groupBy("uid", node.alias("node")).applyInPandas(composed, schema), "alignment-fragments", "lz4")
        closed.append(rows.where(F.col("kind") == CLOSED))
        parts, level = rows.where(F.col("kind") == OPEN), level + 1
    closed.append(parts.mapInPandas(finished, schema))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return written(out, "alignment-groups", "lz4"), bad


def _digests(closed: DataFrame) -> DataFrame:
    """(uid, groups_sha256): the digest of each document's groups runs over its rows in order and keeps its state only."""
    schema = T._parse_datatype_string("uid long, groups_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for uid, shown in zip(batch["uid"].to_pylist(), batch["shown"].to_pylist()):
                if uid == now:
                    state.update(b";")
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = uid, hashlib.sha256()
                state.update(shown.encode())
        if now is not None:
            done.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=schema.names)

    return closed.select("uid", "at", "shown").repartition("uid").sortWithinPartitions("uid", "at").select("uid", "shown").mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Align the tokens of a byte-level vocabulary (A, over a blank and the text) and a piece model (B) on every document.

    Returns key, n_a, n_b, n_groups, n_links, n_best (links whose pair is counted as often as any of its B id, in the whole
    table), count_sum (sum of the counts of all links) and groups_sha256 (digest of ``a1,a2|b1;a3|b2,b3``), one row per row
    of ``docs``. Null or empty texts, and texts whose bytes either tokenizer does not keep, have zeros and an empty digest
    and add no links. Repeated rows count as often as they occur; keys may be null or repeated and of any type; other
    columns are ignored. An empty table gives no rows.
    """
    sources = _sources(docs, a_path, b_path)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_uid"))
    large = F.coalesce(F.octet_length("_text"), F.lit(0)) > LONG
    kind = docs.schema[key].dataType
    blocks = written(short_blocks(rows.where(~large), sources, "_key", "_text"), "alignment-blocks", "lz4")
    far = written(rows.where(large), "alignment-long")
    closed, _ = long_pieces(far, sources, "_text")
    own = closed.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("_z")).select("uid", F.col("_z.pairs").alias("pair"), F.col("_z.times").alias("n"))
    own = written(own.groupBy("uid", "pair").agg(F.sum("n").alias("n")), "alignment-links", "lz4")

    counts = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("_z")).select(F.col("_z.pairs").alias("pair"), F.col("_z.times").alias("n"))
    counts = written(counts.unionByName(own.select("pair", "n")).groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts", "lz4")
    b = F.pmod(F.col("pair"), F.lit(WIDE))
    top = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_top"))
    rated = counts.withColumn("_b", b).join(top, "_b").select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))
    rated = written(rated, "alignment-rated", "lz4")

    short = rated_blocks(blocks, rated, kind)
    sums = closed.groupBy("uid").agg(*[F.sum(n).alias(n) for n in FIGURES])
    links = own.join(rated, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    known = sums.join(links, "uid").join(_digests(closed), "uid")
    zero = F.lit(0).cast("long")
    spread = far.select(F.col("_uid").alias("uid"), F.col("_key").alias("key")).join(known, "uid", "left").select(
        "key", *[F.coalesce(n, zero).alias(n) for n in (*FIGURES, "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return short.unionByName(spread).withColumnRenamed("key", key)
