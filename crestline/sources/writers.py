"""Partitioned output, package manifests and append-only logs."""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from functools import partial

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", replace_touched: bool = False,
                      rows_per_file: int = 5_000_000) -> None:
    """Write by partition. ``replace_touched`` replaces only the partitions present in ``df``; the
    job commit makes them visible at once and leaves the old ones in place when the job fails.

    The rebalance hint brings the rows of a partition together and lets adaptive execution split a
    large one over several tasks and files.
    """
    mode = "dynamic" if replace_touched else "static"
    (df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", mode)
     .option("maxRecordsPerFile", rows_per_file).partitionBy(*by).format(fmt).save(path))


#: Neighbouring numbers in one folder of :func:`write_texts`, so that folders are short and Spark lists them in parallel.
SHELF = 1000
#: Most folders of :func:`write_texts` for a sign, however far apart the numbers are: who lists them holds their names. A prime, for even steps.
SHELVES = 4093


def _shelf(number: int | None) -> int | str:
    if number is None:
        return "null"
    shelf = number // SHELF
    return shelf % SHELVES if shelf >= 0 else -(-shelf % SHELVES)


def _put_texts(rows: Iterable[Row], path: str, ident: str, text: str) -> None:
    """Texts of a partition as files; a file gets its name once it is whole, so a second attempt does no harm."""
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    made, mine = set(), uuid.uuid4().hex
    for row in rows:
        number = row[ident]
        folder = f"{root}/shelf={_shelf(number)}"
        if folder not in made:
            files.create_dir(folder)
            made.add(folder)
        draft = f"{folder}/_{ident}={number}.{mine}"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(row[text].encode())
        files.move(draft, f"{folder}/{ident}={number}.txt")


def write_texts(df: DataFrame, path: str, ident: str, text: str) -> None:
    """Every row's text as a file ``shelf=<of ident>/<name of ident>=<ident>.txt``; ``ident`` is a long, unique.

    Spark's writer makes a folder a partition value and commits them one after the other in the driver; for very many
    small files the tasks write them instead, through the file system of ``path``.
    """
    df.select(ident, text).foreachPartition(partial(_put_texts, path=path, ident=ident, text=text))


def append_daily(df: DataFrame, path: str, stamp: str) -> None:
    df.withColumn("day", F.to_date(stamp)).write.mode("append").partitionBy("day").parquet(path)


def package_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Relative path, size and sha256 of every data file below a folder.

    The folder is cut off the front of a file's path, behind an optional scheme and host, so a folder of the same name
    further down or up does not mislead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    root = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?\Q" + folder + r"\E/(.*)$"
    return files.select(
        F.regexp_extract("path", root, 1).alias("path"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed."""
    a = recorded.select("path", F.col("bytes").alias("was_bytes"), F.col("sha256").alias("was"))
    b = actual.select("path", F.col("bytes").alias("is_bytes"), F.col("sha256").alias("is"))
    problem = (F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unexpected")
               .when(F.col("is") != F.col("was"), "changed"))
    return a.join(b, "path", "full").withColumn("problem", problem).where("problem is not null").select("path", "problem")
