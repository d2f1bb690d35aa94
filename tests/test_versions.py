"""Versions become current as a whole or not at all."""
import pytest
from pyspark.sql import functions as F

from crestline.session import workspace
from crestline.sources import versions as V


@pytest.fixture()
def path(spark):
    return workspace(spark, "versions")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_no_version(spark, path):
    assert V.last_commit(spark, path) is None and V.commits(spark, path).count() == 0
    with pytest.raises(ValueError):
        V.current(spark, path)
    with pytest.raises(ValueError):
        V.rollback(spark, path, 1)
    assert V.discard(spark, path, 1) == []


def test_publish_and_rollback(spark, path):
    assert V.publish(spark.range(3), path) == 1
    assert V.publish(spark.range(5).withColumn("p", F.col("id") % 2), path, ["p"], "json", covers=7) == 2
    now = V.current(spark, path)
    assert ids(now) == [0, 1, 2, 3, 4] and now.columns == ["id", "p"] and V.last_commit(spark, path).covers == 7
    assert ids(V.current(spark, path, 1)) == [0, 1, 2]
    assert V.rollback(spark, path, 1) == 3
    assert ids(V.current(spark, path)) == [0, 1, 2]
    with pytest.raises(ValueError):
        V.rollback(spark, path, 9)


def test_a_version_may_be_made_of_the_current_one(spark, path):
    V.publish(spark.range(3), path)
    V.publish(V.current(spark, path).where("id > 0"), path)
    V.publish(V.current(spark, path).where("id > 5"), path)
    empty = V.current(spark, path)
    assert empty.count() == 0 and empty.columns == ["id"]


def test_failed_write_leaves_the_old_version(spark, path):
    V.publish(spark.range(100), path)
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error("broken").cast("long")).otherwise(F.col("id") + 1).alias("id"))
    with pytest.raises(Exception, match="broken"):
        V.publish(broken, path)
    assert ids(V.current(spark, path)) == list(range(100))
    assert V.publish(spark.range(2), path) == 2


def test_failed_commit_leaves_the_old_version(spark, path, monkeypatch):
    V.publish(spark.range(4), path)

    def fail(*_):
        raise OSError("no commit")
    monkeypatch.setattr(V, "_commit", fail)
    with pytest.raises(OSError):
        V.publish(spark.range(9), path)
    monkeypatch.undo()
    assert ids(V.current(spark, path)) == [0, 1, 2, 3]
    assert len(V.discard(spark, path, 1)) == 1
    assert ids(V.current(spark, path)) == [0, 1, 2, 3]


def test_two_writers_of_a_number(spark, path):
    V.publish(spark.range(4), path)
    commit = V.last_commit(spark, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        V._commit(spark, path, tuple(commit))
