"""SentencePiece encoding with source offsets, and decoding.

The normaliser is this module's own: longest-prefix replacement through the character map compiled into the model, with
the source byte of every normalised byte kept. Segmentation of normalised text is the library's. Every piece is then
projected to the bytes of the original text that it came from.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece as spm
from pyspark.sql import DataFrame, types as T
from sentencepiece import sentencepiece_model_pb2 as spb

from .arrow import add_lists, data_of, lists_of, slices, strings_of, texts

MARK = "▁".encode()
#: Distinct parts of text whose ids a worker keeps between batches, and bytes of text encoded at once.
MEMO = 300_000
SLICE_BYTES = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Entries of a compiled map: a double-array trie whose leaves point at zero-ended replacement strings."""
    if not blob:
        return {}
    size, = struct.unpack_from("<I", blob)
    units, pool = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size:]
    shift = [(u >> 10) << ((u & 512) >> 6) for u in units]
    found, stack = {}, [(0, b"")]
    while stack:
        node, key = stack.pop()
        base = node ^ shift[node]
        if units[node] >> 8 & 1:
            start = units[base] & 0x7FFFFFFF
            found[key] = pool[start:pool.index(0, start)]
        for byte in range(1, 256):
            child = base ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                stack.append((child, key + bytes([byte])))
    return found


class Model:
    """A model split into normaliser, library segmenter over normalised text, and tables of pieces."""

    def __init__(self, blob: bytes):
        proto = spb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.map = character_map(spec.precompiled_charsmap)
        self.users = {p.piece.encode() for p in proto.pieces if p.type == USER}
        self.heads = {k[:1] for k in self.map} | {k[:1] for k in self.users}
        self.longest = max(map(len, [*self.map, *self.users, b""]))
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.size = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.plain = not self.map and not self.users and not self.squeeze and self.escape and not self.suffix
        inner = any(MARK in p.piece.encode().lstrip(MARK) for p in proto.pieces if p.type != BYTE)
        #: Parts starting at a space can be segmented apart: no piece reaches over the start of one.
        self.apart = not inner and bool(proto.trainer_spec.byte_fallback) and not self.suffix
        self.whole = spm.SentencePieceProcessor(model_proto=blob)
        self.bos, self.eos = self.whole.bos_id(), self.whole.eos_id()
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        proto.ClearField("denormalizer_spec")
        self.memo: dict[str, bytes] = {}
        self.room = MEMO
        self.segment = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the source byte."""
        out, source, at = [], [], 0
        while at < len(text):
            piece, put = b"", b""
            if text[at:at + 1] in self.heads:
                for length in range(min(self.longest, len(text) - at), 0, -1):
                    head = text[at:at + length]
                    if head in self.users or head in self.map:
                        piece, put = head, head if head in self.users else self.map[head]
                        break
            if not piece:
                lead = text[at]
                piece = put = text[at:at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)]
            out.append(put)
            source.append((at, len(put)))
            at += len(piece)
        body = b"".join(out)
        align = np.repeat(np.array([a for a, _ in source], np.int64), [n for _, n in source]) if source else np.zeros(0, np.int64)
        raw = np.frombuffer(body, np.uint8)
        if self.squeeze and len(raw):
            space = raw == 32
            keep = ~space | np.concatenate([[False], ~space[:-1]])
            last = np.flatnonzero(~space)
            keep[(last[-1] + 1 if len(last) else 0):] = False
            raw, align = raw[keep], align[keep]
        end = len(text)
        if not len(raw):
            return b"", np.array([end])
        extra = np.array([32], np.uint8)
        if self.dummy:
            raw, align = (np.concatenate([raw, extra]), np.append(align, end)) if self.suffix else (np.concatenate([extra, raw]), np.insert(align, 0, align[0]))
        if self.escape:
            times = np.where(raw == 32, 3, 1)
            body, align = raw.tobytes().replace(b" ", MARK), np.repeat(align, times)
        else:
            body = raw.tobytes()
        return body, np.append(align, end)

    def normalised(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a batch: offsets of the normalised texts, their bytes, and the source byte of each byte and text end."""
        if not self.plain:
            bodies, aligns = zip(*(self.normalise(t.encode()) for t in strings.to_pylist())) if len(strings) else ((), ())
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
            return offsets, np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(aligns) if aligns else np.zeros(0, np.int64)
        ends, body = data_of(strings)
        lengths = np.diff(ends)
        times = np.where(body == 32, 3, 1)
        # one slot more per text for its end, and three before it for the prefix of a text that isn't empty
        prefix = np.where(lengths > 0, 3 * self.dummy, 0)
        local = np.arange(len(body)) - np.repeat(ends[:-1], lengths)
        grown = np.repeat(local, times)
        upto = np.concatenate([[0], np.cumsum(times)])[ends]
        wide = np.diff(upto)
        offsets = np.concatenate([[0], np.cumsum(wide + prefix)])
        align = np.zeros(offsets[-1] + len(lengths), np.int32)
        rows = np.arange(len(lengths))
        align[np.arange(upto[-1]) + np.repeat(offsets[:-1] + rows + prefix - upto[:-1], wide)] = grown
        align[offsets[1:] + rows] = lengths
        marked = pc.replace_substring(strings, " ", MARK.decode())
        if self.dummy:
            marked = pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(MARK.decode(), marked, ""))
        return offsets, data_of(marked)[1], align

    def coded(self, parts: list[str]) -> pa.Array:
        """Id lists of distinct parts; a bounded memo keeps those of earlier batches."""
        new = [p for p in parts if p not in self.memo]
        if len(self.memo) + len(new) > self.room:
            self.memo.clear()
            new = parts
        for part, ids in zip(new, self.segment.encode(new, num_threads=1)):
            self.memo[part] = np.array(ids, np.int32).tobytes()
        found = [self.memo[p] for p in parts]
        return lists_of(np.frombuffer(b"".join(found), np.int32), np.array([len(f) // 4 for f in found], np.int64))

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ids per text, and the source span of each piece."""
        offsets, body, align = self.normalised(strings)
        rows, n = np.arange(len(strings)), len(body)
        if not self.apart:
            protos = self.segment.encode([bytes(body[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])], out_type="immutable_proto")
            count = np.array([len(p.pieces) for p in protos], np.int64)
            ids = np.array([x.id for p in protos for x in p.pieces], np.int32)
            size = np.array([len(x.surface.encode()) for p in protos for x in p.pieces], np.int64)
        else:
            mark = np.zeros(n, bool)
            if n > 2:
                mark[:-2] = (body[:-2] == MARK[0]) & (body[1:-1] == MARK[1]) & (body[2:] == MARK[2])
            start = mark.copy()
            start[3:] &= ~mark[:-3]
            full = offsets[:-1][np.diff(offsets) > 0]
            start[full] = True
            cuts = np.append(np.flatnonzero(start), n)
            parts = strings_of(cuts, body).dictionary_encode()
            lists = self.coded(parts.dictionary.to_pylist()).take(parts.indices)
            ids = lists.flatten().to_numpy()
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            count = np.diff(upto[np.searchsorted(cuts, offsets)])
            size = self.size[ids].astype(np.int64)
        ends = np.cumsum(size)
        if len(ends) and ends[-1] != n:
            raise ValueError("pieces do not cover the normalised text")
        shift = np.repeat(rows, count)
        return ids, count, align[ends - size + shift].astype(np.int32), align[ends + shift].astype(np.int32)


_MODELS: dict[bytes, Model] = {}


def _model(blob: bytes) -> Model:
    if blob not in _MODELS:
        _MODELS.clear()
        _MODELS[blob] = Model(blob)
    return _MODELS[blob]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _coded(model: Model, source: pa.Array, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ends of the texts' ids, numbers of ids, and ids, begins and ends of all pieces with begin and end ids around."""
    ids, count, begins, ends = model.encode(source)
    width = np.diff(data_of(source)[0]).astype(np.int32)
    total = count + bos + eos
    at = np.arange(len(ids)) + np.repeat(np.arange(len(count)) * (bos + eos) + bos, count)
    upto, flat = np.concatenate([[0], np.cumsum(total)]), []
    for values, first, last in ((ids, model.bos, model.eos), (begins, 0, width), (ends, 0, width)):
        whole = np.empty(upto[-1], np.int32)
        whole[at] = values
        if bos:
            whole[upto[:-1]] = first
        if eos:
            whole[upto[1:] - 1] = last
        flat.append(whole)
    return upto, total, flat


def encode(df: DataFrame, model_path: str, text: str = "text", bos: bool = True, eos: bool = True,
           spans: bool = True, decoded: str | None = None) -> DataFrame:
    """Append ``ids`` and the source spans ``begins``, ``ends`` (byte offsets into the text's UTF-8) of every piece.

    Begin and end ids have empty spans at both ends of the text. Null counts as the empty text, which has only the begin
    and end ids. Texts of any length are encoded whole; an empty table gives an empty table; other columns, also with
    clashing names, stay (columns of the new names are replaced). ``decoded`` names a column for what the ids decode to,
    made in the same pass by the same model. Nothing is shuffled. The model file is read by the driver and sent to the
    tasks; its size does not depend on the data.
    """
    new = ["ids", "begins", "ends"] if spans else ["ids"]
    base = df.drop(*[c for c in ("ids", "begins", "ends", decoded) if c and c != text])
    blob, columns = df.sparkSession.sparkContext.broadcast(_read(model_path)), base.columns
    schema = add_lists(base, new)
    if decoded:
        schema = T.StructType([*schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob.value)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                upto, total, flat = _coded(model, texts(part, text), bos, eos)
                out = [lists_of(values, total) for values in flat[:len(new)]]
                if decoded:
                    out.append(pa.array([model.whole.decode(flat[0][a:b].tolist()) for a, b in zip(upto[:-1], upto[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([part[c] for c in columns] + out, names=schema.names)

    return base.mapInArrow(run, schema)


def digests(df: DataFrame, model_path: str, text: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """Append ``n_tokens``, the SHA-256 of the ids as little-endian 32-bit numbers, and that of their decoding.

    As :func:`encode` with ``decoded``, of which only digests leave the task. ``text`` goes, other columns stay.
    """
    import hashlib
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    columns = [c for c in df.columns if c not in (text, *new)]
    base = df.select(*columns, text)
    blob = df.sparkSession.sparkContext.broadcast(_read(model_path))
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in new[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob.value)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                upto, total, flat = _coded(model, texts(part, text), bos, eos)
                each = [flat[0][a:b] for a, b in zip(upto[:-1], upto[1:])]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in columns], pa.array(total), pa.array([sha(x.astype("<u4").tobytes()) for x in each], pa.string()),
                                                  pa.array([sha(model.whole.decode(x.tolist()).encode()) for x in each], pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Append the library's decoding of the id lists; null ids decode to null, no ids to the empty text."""
    base = df.drop(into)
    blob, columns = df.sparkSession.sparkContext.broadcast(_read(model_path)), base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part[ids].to_pylist()
                back = pa.array([None if x is None else model.whole.decode(x) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([part[c] for c in columns] + [back], names=columns + [into])

    return base.mapInArrow(run, T.StructType(list(base.schema.fields) + [T.StructField(into, T.StringType())]))


def digest_ids(df: DataFrame, ids: str = "ids", into: str = "ids_sha256") -> DataFrame:
    """Replace the id lists by their number ``n_tokens`` and the SHA-256 of their little-endian 32-bit form."""
    import hashlib
    columns = [c for c in df.columns if c != ids]
    fields = [df.schema[c] for c in columns] + [T.StructField("n_tokens", T.LongType()), T.StructField(into, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[ids]
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4") if len(lists) else np.zeros(0, "<u4")
            ends = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
            marks = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(np.diff(ends).astype(np.int64)), pa.array(marks, pa.string())],
                                             names=columns + ["n_tokens", into])

    return df.mapInArrow(run, T.StructType(fields))
