"""WARC archives: round trip, members, sidecars and duplicate payloads."""
import gzip
import hashlib

import pyarrow.fs as pafs

from crestline.llm import warc
from crestline.llm.storage import shared_path

LONG = "<p>" + "long payload " * 20 + "</p>"
ROWS = [(1, "http://a/1", LONG), (2, "http://a/2\r\nX: y", LONG), (3, None, LONG + "é"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
        (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (1, "http://a/1", LONG), (None, "u", LONG), (9, "u", "x" * 3_000_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([r + ("clash",) for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive(pages).collect()), key=repr)
    want = []
    for key, _, html in ROWS:
        raw = (html or "").encode()
        same = [k for k, _, h in ROWS if (h or "") == (html or "") and k is not None]
        other = len(raw) >= 100 and len(same) + (key is None) > 1 and key != min(same)
        want.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", min(same) if other else None))
    assert got == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).count() == 0


def test_each_record_is_a_member(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_monolithic(warc.with_revisits(pages), shared_path(spark, "mono"))
    (name, n), = archives.collect()
    fs, inner = pafs.FileSystem.from_uri(name)
    mono = fs.open_input_file(inner).read()
    assert n == len(ROWS) and mono.count(b"\x1f\x8b\x08") >= 1
    index = warc.normalise(archives, shared_path(spark, "new")).orderBy("offset").collect()
    fs, inner = pafs.FileSystem.from_uri(index[0].archive)
    data = fs.open_input_file(inner).read()
    parts = [gzip.decompress(data[r.offset:r.offset + r.length]) for r in index]
    assert b"".join(parts) == gzip.decompress(mono)
    sidecar = fs.open_input_file(inner + ".idx").read().decode().splitlines()
    assert [line.split("\t")[:2] for line in sidecar] == [[str(r.offset), str(r.length)] for r in index]


def test_query_equals_sql(spark, duck, sf):
    from crestline.llm.registry import ORACLES, QUERIES
    rel = duck.sql(ORACLES["op8_warc"])
    got = QUERIES["op8_warc"](spark, sf).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
