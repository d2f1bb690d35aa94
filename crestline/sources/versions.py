"""Versioned datasets: a version is written whole into a folder of its own, then one commit row makes it the current one.

A dataset is a folder with ``versions/<folder>`` and ``commits/<number>``. A commit is a table of one row, so the engine's job
commit shows it whole or not at all; whatever fails before leaves the version before in place. Commits are never changed: going
back to a version is a further commit that names its folder. One writer at a time: a second writer of the same number fails.
"""
from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "number long, folder string, format string, columns string, covers long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits of a dataset: number, folder, format, columns as JSON, the mark ``covers``. No rows for a path without any."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def last_commit(spark: SparkSession, path: str, number: int | None = None):
    """The commit of that number, the newest one without a number; None where there is none."""
    found = commits(spark, path)
    return (found if number is None else found.where(F.col("number") == number)).orderBy(F.desc("number")).first()


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("errorifexists").json(f"{path}/commits/{row[0]:010d}")


def publish(df: DataFrame, path: str, by: list[str] = (), fmt: str = "parquet", covers: int | None = None) -> int:
    """Write ``df`` as the next version and make it current; returns the number of the commit.

    ``covers`` is a mark kept with the commit, such as the last batch that the version holds. ``df`` may read the current
    version, since no file of it is touched. An empty ``df`` gives an empty version with its columns.
    """
    spark, last = df.sparkSession, last_commit(df.sparkSession, path)
    number = 1 if last is None else last.number + 1
    folder = f"{number:010d}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(f"{path}/versions/{folder}")
    _commit(spark, path, (number, folder, fmt, df.schema.json(), covers))
    return number


def rollback(spark: SparkSession, path: str, number: int) -> int:
    """Make the version of commit ``number`` current again; returns the number of the new commit."""
    wanted, last = last_commit(spark, path, number), last_commit(spark, path)
    if wanted is None:
        raise ValueError(f"{path} has no commit {number}")
    _commit(spark, path, (last.number + 1, wanted.folder, wanted.format, wanted.columns, wanted.covers))
    return last.number + 1


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The current version, or that of commit ``number``, as it was published."""
    commit = last_commit(spark, path, number)
    if commit is None:
        raise ValueError(f"{path} has no commit" + ("" if number is None else f" {number}"))
    return opened(spark, path, commit)


def opened(spark: SparkSession, path: str, commit) -> DataFrame:
    schema = StructType.fromJson(json.loads(commit.columns))
    return spark.read.format(commit.format).schema(schema).load(f"{path}/versions/{commit.folder}").select(*schema.names)


def discard(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete version folders that none of the last ``keep`` commits names, those of failed writes included; returns their
    names. Call it while nobody writes; readers of a version deleted here fail."""
    kept = {r.folder for r in commits(spark, path).orderBy(F.desc("number")).limit(max(1, keep)).collect()}
    files, inner = pafs.FileSystem.from_uri(f"{path}/versions")
    gone = [f for f in files.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.base_name not in kept]
    for folder in gone:
        files.delete_dir(folder.path)
    return sorted(f.base_name for f in gone)
