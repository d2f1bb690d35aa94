"""Content scans, JSON manifests and the adapter registry."""
from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import EXTENSIONS, parse_json
from ..session import workspace

#: Files whose listing the driver holds at once; a scan of more files goes batch by batch.
FILES = 1 << 15
#: Files and bytes that make a task of a scan.
TASK_FILES, TASK_BYTES = 256, 128 << 20
#: Bytes of listings that Spark keeps in the driver when they are no longer used; no scan reads one again.
_LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"

Adapter = Callable[..., DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register(name: str) -> Callable[[Adapter], Adapter]:
    def add(fn: Adapter) -> Adapter:
        _ADAPTERS[name] = fn
        return fn
    return add


def adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise KeyError(f"unknown source adapter {name!r}; known: {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name]


def _hidden(name: str) -> bool:
    """Names below a folder that Spark does not list."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _parts(fs, path) -> Iterator[tuple[str, int, int]]:
    """Path, files and bytes of ``path``, or of what it holds if that is more than ``FILES`` files.

    Files are counted inside the JVM; only what stands directly in a folder that is split comes to Python, one by one.
    """
    held = fs.getContentSummary(path)
    if held.getFileCount() <= FILES:
        yield path.toString(), held.getFileCount(), held.getLength()
        return
    entries = fs.listStatusIterator(path)
    while entries.hasNext():
        entry = entries.next()
        child = entry.getPath()
        if _hidden(child.getName()):
            continue
        if entry.isDirectory():
            yield from _parts(fs, child)
        else:
            yield child.toString(), 1, entry.getLen()


def _tops(matches: Iterable) -> Iterator:
    """Paths of sorted ``matches`` of a pattern, without repeats and what lies below another one, as Spark lists a file once."""
    taken = set()
    for match in matches:
        path = match.getPath()
        name = path.toString().rstrip("/")
        if name in taken or any(name[:i] in taken for i, c in enumerate(name) if c == "/"):
            continue
        taken.add(name)
        yield path


def _batches(spark: SparkSession, path: str) -> Iterator[tuple[list[str], int]]:
    """Paths that together hold the files below ``path``, at most ``FILES`` a batch, with the number of tasks for them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    tasks = lambda: max(spark.sparkContext.defaultParallelism, files // TASK_FILES, size // TASK_BYTES)
    paths, files, size = [], 0, 0
    for top in _tops(fs.globStatus(root) or ()):
        for part, n, length in _parts(fs, top):
            if paths and files + n > FILES:
                yield paths, tasks()
                paths, files, size = [], 0, 0
            if n:
                paths.append(part)
                files, size = files + n, size + length
    yield paths, tasks()


def _files(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...], lenient: bool = False) -> DataFrame:
    """Files below ``path``; other extensions (in any case) are left out while folders are listed, before a file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        cases = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(cases) + "}")
    if lenient:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    size = spark.conf.get(_LISTINGS)
    spark.conf.set(_LISTINGS, 0)
    try:
        return reader.load(path)
    finally:
        spark.conf.set(_LISTINGS, size)


def _scanned(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...], largest: int, tasks: int) -> DataFrame:
    """Rows of :func:`scan_content` for the files below ``path``, read by ``tasks`` tasks, each of many files."""
    listed = _files(spark, path, extensions).select("path", F.col("length").alias("size_bytes")).coalesce(tasks)
    read = _files(spark, path, extensions, lenient=True).where(F.col("length") <= largest)
    digests = read.select(F.col("path").alias("_path"), F.md5("content").alias("md5")).coalesce(tasks)
    both = listed.join(digests, F.col("path") == F.col("_path"), "left")
    error = F.when(F.col("size_bytes") > largest, "too large").when(F.col("md5").isNull(), "unreadable")
    return both.select("path", "md5", "size_bytes", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("title"), error.alias("error"))


@register("content")
def scan_content(spark: SparkSession, path: str, extensions=EXTENSIONS, largest: int = (1 << 31) - 1) -> DataFrame:
    """Recursive scan of files with the given extensions (any case): path, digest, size, title and error.

    Spark lists the folders (in a job of its own where there are many) and deals the files to tasks; each file is read
    inside a task, and only its digest leaves it. A file that cannot be read does not end the scan: it has a null digest
    and the error ``unreadable``, one of more than ``largest`` bytes, which is not opened, ``too large``. The listing
    itself opens nothing; it is joined with the digests by path.

    Spark keeps a listing and its tasks in the driver. More than ``FILES`` files are therefore scanned at once, batch by
    batch, and the rows are kept below the shared folder; a smaller scan runs when its rows are asked for.
    """
    wanted, batches = tuple(extensions), _batches(spark, path)
    some = [*itertools.islice(batches, 2)]
    if len(some) < 2:
        return _scanned(spark, path, wanted, largest, some[0][1])
    out = workspace(spark, "scanned")
    for paths, tasks in itertools.chain(some, batches):
        plain = [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths]  # no patterns
        rows = _scanned(spark, plain, wanted, largest, tasks)
        rows.write.mode("append").parquet(out)
        schema = rows.schema
        del rows
        gc.collect()  # Python's handles of a batch are cycles, and they hold its listing in the driver
    return spark.read.schema(schema).parquet(out)


@register("parquet")
def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@register("orc")
def scan_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


@register("json")
def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@register("csv")
def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document file: name and text."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def merge_manifests(documents: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Entries of all JSON objects of a key; later documents override earlier entries.

    Malformed documents are skipped. One row per (key, entry), never one growing map.
    """
    parsed = documents.withColumn("_map", parse_json(F.col(text), "map<string,string>")).where("_map is not null")
    entries = parsed.select(*keys, order, F.explode("_map").alias("entry", "value"))
    return entries.groupBy(*keys, "entry").agg(F.max_by("value", order).alias("value"))
