"""WARC archives: monolithic gzip streams, their normalisation to one member per record, and reading by offset."""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import slices
from .storage import opened, shared_path, written

#: Uncompressed bytes after which a task begins the next archive.
ARCHIVE_BYTES = 128 << 20
CHUNK = 1 << 20
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 100) -> DataFrame:
    """Append payload_bytes, payload_digest and refers_to (the smallest key with the same payload, null for itself).

    Payloads shorter than ``least`` bytes and rows without an equal elsewhere refer to nothing. Null payloads are empty.
    Rows that share the smallest key are all responses; a null key is never referred to.
    """
    body = F.coalesce(F.col(payload), F.lit("")).alias(payload)
    rows = pages.select(key, "url", body).withColumn("payload_bytes", F.octet_length(payload).cast("long")) \
        .withColumn("payload_digest", F.sha2(F.col(payload).cast("binary"), 256))
    large = rows.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest").agg(F.min(key).alias("first"), F.count("*").alias("copies")) \
        .where("copies > 1").select("payload_digest", "first")
    joined = rows.join(first, "payload_digest", "left")
    other = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col(key).eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def record(page_id, url, html: str, payload_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit carries the HTTP head of its page, whose length tells that of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head if refers_to is not None else head + html.encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_monolithic(rows: DataFrame, folder: str, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write the rows as archives that are one gzip stream each; returns a written list of (archive, records).

    Names are unique per attempt, and only archives in the list count, so a repeated task leaves no double records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def close() -> pa.RecordBatch:
            state["file"].write(state["zip"].flush())
            state["file"].close()
            done = pa.RecordBatch.from_pydict({"archive": [state["name"]], "records": pa.array([state["n"]], pa.int64())})
            state.clear()
            return done

        for batch in batches:
            for part in slices(batch, payload):
                columns = [part[c].to_pylist() for c in (key, "url", payload, "payload_bytes", "payload_digest", "refers_to")]
                for row in zip(*columns):
                    if not state:
                        name = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz"
                        fs, inner = opened(name)
                        state.update(name=name, file=fs.open_output_stream(inner, compression=None), zip=zlib.compressobj(6, wbits=31), n=0, size=0)
                    data = record(*row)
                    state["file"].write(state["zip"].compress(data))
                    state["n"] += 1
                    state["size"] += len(data)
                    if state["size"] >= ARCHIVE_BYTES:
                        yield close()
        if state:
            yield close()

    _make(folder)
    return written(rows.mapInArrow(run, "archive string, records long"), "warc-list")


def _make(folder: str) -> None:
    fs, inner = opened(folder)
    fs.create_dir(inner, recursive=True)


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file, read and inflated once from start to end; further members are followed."""
    unzip, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or file.read(CHUNK)
        if not data:
            break
        out = unzip.decompress(data, CHUNK)
        if out:
            yield out
        rest = unzip.unconsumed_tail
        if unzip.eof:
            rest, unzip = unzip.unused_data, zlib.decompressobj(31)
    if out := unzip.flush():
        yield out


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of a stream; holds one record and one chunk."""
    have, chunks = bytearray(), iter(chunks)

    def until(size: int) -> bool:
        while len(have) < size:
            more = next(chunks, None)
            if more is None:
                return False
            have.extend(more)
        return True

    seen = 0
    while True:
        end = have.find(b"\r\n\r\n", max(0, seen - 3))
        if end < 0:
            seen = len(have)
            if not until(seen + 1):
                if bytes(have).strip():
                    raise ValueError("archive ends inside a record")
                return
            continue
        head = bytes(have[:end + 4])
        size = int(fields(head)["content-length"])
        if not until(len(head) + size + 4):
            raise ValueError("archive ends inside a record")
        block = bytes(have[len(head):len(head) + size])
        del have[:len(head) + size + 4]
        seen = 0
        yield head, block


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate each archive once and rewrite every record as a gzip member of its own.

    Next to each new archive stands a sidecar of tab-separated offset, length, type and record id. The same rows are
    returned, written: (archive, offset, length, record_type, record_id).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["archive"].to_pylist():
                fs, inner = opened(name)
                new = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                out_fs, out_inner = opened(new)
                at, rows = 0, []
                with fs.open_input_stream(inner, compression=None) as source, out_fs.open_output_stream(out_inner, compression=None) as target, \
                        out_fs.open_output_stream(out_inner + ".idx", compression=None) as sidecar:
                    for head, block in records(inflated(source)):
                        zip_ = zlib.compressobj(6, wbits=31)
                        member = zip_.compress(head + block + b"\r\n\r\n") + zip_.flush()
                        target.write(member)
                        found = fields(head)
                        rows.append((new, at, len(member), found["warc-type"], found["warc-record-id"]))
                        sidecar.write("\t".join(map(str, rows[-1][1:])).encode() + b"\n")
                        at += len(member)
                        if len(rows) >= 10_000:
                            yield _index(rows)
                            rows = []
                if rows:
                    yield _index(rows)

    _make(folder)
    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")  # a task per archive, not merged
    return written(spread.mapInArrow(run, "archive string, offset long, length long, record_type string, record_id string"), "warc-index")


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["archive", "offset", "length", "record_type", "record_id"])


def read(index: DataFrame, key_type: str = "long") -> DataFrame:
    """Read records by their offsets: key, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from its payload and must equal the one in its head. A revisit has no payload;
    length and digest are those its heads keep.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if file is not None:
                        file.close()
                    fs, inner = opened(archive)
                    name, file = archive, fs.open_input_file(inner)
                raw = file.read_at(length, offset)
                (head, block), = records(iter([zlib.decompress(raw, 31)]))
                found = fields(head)
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest, size = found["warc-type"], found["warc-payload-digest"].removeprefix("sha256:"), int(fields(http)["content-length"])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"payload of {found['warc-record-id']} is damaged")
                own, refers = (found.get(k, "").strip("<>").removeprefix(URN) or None for k in ("warc-record-id", "warc-refers-to"))
                rows.append((own, size, digest, kind, refers))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                                                 names=["key", "payload_bytes", "payload_digest", "record_type", "refers"])
        if file is not None:
            file.close()

    spread = index.repartition(max(1, index.select("archive").distinct().count()), "archive").sortWithinPartitions("archive", "offset")
    found = spread.mapInArrow(run, "key string, payload_bytes long, payload_digest string, record_type string, refers string")
    return found.select(F.col("key").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers").cast(key_type).alias("refers_to"))


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write pages to monolithic archives, normalise these, and read every record back from the new ones."""
    spark = pages.sparkSession
    rows = with_revisits(pages, key, payload)
    archives = write_monolithic(rows, shared_path(spark, "warc-mono"), key, payload)
    return read(normalise(archives, shared_path(spark, "warc")), pages.schema[key].dataType.simpleString())
