"""Scans of files: errors as rows, counts of an ingest, manifests in folders of confusing names."""
import hashlib
import os

import pytest
from pyspark.sql import Row

from crestline.operators import catalog as C
from crestline.sources import readers as R
from crestline.sources import writers as W


@pytest.fixture()
def folder(spark, tmp_path):
    """Three readable files, one whose content no longer fits its checksum, and one of another extension."""
    path = tmp_path / "in"
    spark.range(40).selectExpr("CAST(id AS STRING)").coalesce(1).write.text(str(path / "broken"))
    part = next((path / "broken").glob("part-*.txt"))
    part.write_bytes(b"#" * part.stat().st_size)
    for name, text in (("a.txt", "one"), ("deep/er/B.TXT", "one"), ("deep/c.Txt", "longer text"), ("deep/d.wav", "no")):
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    return path


def test_a_broken_file_is_a_row_with_an_error(spark, folder):
    found = {r.title: (r.md5, r.size_bytes, r.error) for r in R.scan_content(spark, str(folder), ("txt",)).collect()}
    one, long = (hashlib.md5(t).hexdigest() for t in (b"one", b"longer text"))
    broken = next(t for t in found if t.startswith("part-"))
    assert found.pop(broken) == (None, size_of_broken(folder), "unreadable")
    assert found == {"a": (one, 3, None), "B": (one, 3, None), "c": (long, 11, None)}


def size_of_broken(folder):
    return next((folder / "broken").glob("part-*.txt")).stat().st_size


def test_files_beyond_the_limit_are_not_opened(spark, folder):
    found = {r.title: r.error for r in R.scan_content(spark, str(folder), ("txt",), largest=10).collect()}
    assert {t[:4]: e for t, e in found.items()} == {"a": None, "B": None, "c": "too large", "part": "too large"}


def test_other_extensions_are_left_out_of_the_listing(spark, folder):
    plan = R.scan_content(spark, str(folder), ("txt",))
    assert not [f for f in plan.inputFiles() if f.endswith(".wav")] and len(plan.inputFiles()) == 4
    assert R.scan_content(spark, str(folder), ("mp3",)).collect() == []


def test_report_counts_every_row_once(spark, folder):
    scan = R.scan_content(spark, str(folder), ("txt",))
    known = spark.createDataFrame([(hashlib.md5(b"longer text").hexdigest(),), (None,)], "md5 string")
    none = known.limit(0)
    report = lambda *a, **k: tuple(C.ingest_report(*a, **k).first())
    assert report(scan, known, "md5", "error") == (4, 1, 1, 1, 1)
    assert report(scan, none, "md5", "error") == (4, 2, 0, 1, 1)
    assert report(scan, known, "md5", force=True) == (4, 2, 0, 1, 1)
    assert report(scan.limit(0), known, "md5") == (0, 0, 0, 0, 0)
    assert C.incremental(scan.where("error IS NULL"), known, "md5", ["path"]).count() == 1


def test_manifest_paths_start_behind_the_folder_itself(spark, tmp_path):
    root = tmp_path / "data" / "x+(1)" / "data"
    for name in ("a.txt", "data/a.txt", "data/data/b.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    want = ["a.txt", "data/a.txt", "data/data/b.txt"]
    assert sorted(r.path for r in W.package_manifest(spark, f"{root}/").collect()) == want
    assert sorted(r.path for r in W.package_manifest(spark, f"file://{root}").collect()) == want


def test_texts_are_written_as_one_file_a_row_in_short_folders(spark, tmp_path, monkeypatch):
    """Numbers far apart, negative and null; no folder a file; a path with a scheme; the texts come back byte by byte."""
    rows = [(i, f"text {i}\né\n") for i in (0, 7, 999, 1000, 2500, -3)] + [(None, "none")]
    for name, path in (("plain", f"{tmp_path}/plain"), ("uri", f"file://{tmp_path}/uri"), ("short", f"file:{tmp_path}/short")):
        W.write_texts(spark.createDataFrame(rows, "file long, text string"), path, "file", "text")
        found = R.scan_content(spark, path, ("txt",)).collect()
        assert sorted((r.title, r.md5) for r in found) == sorted((f"file={i}", hashlib.md5(t.encode()).hexdigest()) for i, t in rows)
        assert sorted(os.listdir(tmp_path / name)) == ["shelf=-1", "shelf=0", "shelf=1", "shelf=2", "shelf=null"]


def test_documents_files_need_no_folder_each(spark, tmp_path):
    from crestline.plans import io_queries as Q
    spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    Q._text_files(spark, str(tmp_path), f"{tmp_path}/out", 8)
    assert [len(files) for _, _, files in os.walk(tmp_path / "out") if files] == [3]
    with open(tmp_path / "out/shelf=0/file=2.txt") as f:
        assert f.read() == "t16\nt17\nt18\nt19\n"


def test_a_scan_of_many_files_lists_a_few_at_once(spark, folder, monkeypatch):
    """Rows as of one listing, from folders below folders, flat ones, hidden names and names that look like patterns."""
    for name in ("x+{1}/[a]/f?*.txt", "x+{1}/[a]/f1.txt", "x1/g\\h.txt", "sp ace,%20/i.txt", "_k=1/j.txt", "_no/n.txt", ".no/n.txt", "deep/_n.txt", "deep/_k=1.txt", "none/o.mp3",
                 *(f"flat/{i}.txt" for i in range(9))):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)
    (folder / "empty").mkdir()
    rows = lambda path, **k: sorted(R.scan_content(spark, path, ("txt",), **k).collect())
    paths = [f"{folder}", f"file://{folder}", f"{folder}/deep/er/B.TXT", f"{folder}/*", f"{folder}/{{deep,fl}}*"]
    kept = spark.conf.get(R._LISTINGS)
    want = {p: rows(p) for p in paths}
    assert len(want[paths[0]]) == 19 and {r.error for r in want[paths[0]]} == {None, "unreadable"}
    listings, load = [], R._files
    monkeypatch.setattr(R, "_files", lambda *a, **k: listings.append(df := load(*a, **k)) or df)
    monkeypatch.setattr(R, "FILES", 4)
    for p in paths:
        assert rows(p) == want[p]
    assert max(len(df.inputFiles()) for df in listings) <= 4 and len(listings) > 20
    assert spark.conf.get(R._LISTINGS) == kept
    assert {r.error for r in rows(paths[0], largest=10)} == {None, "too large"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.scan_content(spark, f"{folder}/nowhere")


def test_a_task_of_a_scan_reads_many_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"{i}")
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")  # four small files
    try:
        assert R._files(spark, str(tmp_path), ("txt",)).rdd.getNumPartitions() > 50
        scanned = R._scanned(spark, str(tmp_path), ("txt",), 1 << 20, 8)
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        assert scanned.count() == 300 and plan.count("Coalesce 8") == 2
        assert "LessThanOrEqual(length,1048576)" in plan and "ReadSchema: struct<path:string,length:bigint>" in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)


def test_a_file_that_a_pattern_matches_twice_is_scanned_once(spark, tmp_path, monkeypatch):
    for i in range(6):
        for name in (f"a/{i}.txt", f"a/b/{i}.txt", f"a-b/{i}.txt"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(name)
    rows = lambda pattern: sorted(R.scan_content(spark, f"{tmp_path}/{pattern}", ("txt",)).collect())
    patterns = {"{a,a/b}": 12, "{a/b,a}": 12, "{a/b,a/b,a-b}": 12, "{*,a/b,a/b/1.txt}": 18, "{a/1.txt,a/?.txt}": 6}
    want = {p: rows(p) for p in patterns}
    assert {p: len(w) for p, w in want.items()} == patterns
    monkeypatch.setattr(R, "FILES", 4)
    for p in patterns:
        assert rows(p) == want[p]


def test_numbers_far_apart_share_folders(spark, tmp_path, monkeypatch):
    """No more than 7 folders for a sign and that of null, where every number had its own."""
    monkeypatch.setattr(W, "SHELVES", 7)
    numbers = [None, *(i * 9_000_001 - 250_000_000 for i in range(60))]
    # one task, in this process, as another one would not see the smaller number of folders
    W._put_texts([Row(file=n, text=f"t{n}") for n in numbers], f"file://{tmp_path}/out", "file", "text")
    found = {f: d for d, _, files in os.walk(tmp_path / "out") for f in files}
    assert set(found) == {f"file={n}.txt" for n in numbers} and len({*found.values()}) == 14
    got = {r.title: r.md5 for r in R.scan_content(spark, f"file://{tmp_path}/out", ("txt",)).collect()}
    assert got == {f"file={n}": hashlib.md5(f"t{n}".encode()).hexdigest() for n in numbers}
