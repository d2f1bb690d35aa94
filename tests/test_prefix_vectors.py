"""Window sums as differences of prefix rows, against sums over all rows."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crestline.operators import prefix_vectors as PV


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_sums_before_edges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2]), rng.randrange(400) / 8, [rng.random(), float(i)]) for i in range(500)]
    edges = sorted({(k, rng.randrange(-8, 450) / 8) for k in (None, 1, 2, 3) for _ in range(40)}, key=str)
    df = spark.createDataFrame(rows, "k long, t double, v array<double>").repartition(3)
    marks = spark.createDataFrame(edges, "k long, t double")
    got = {(r.k, r.t): r.upto for r in PV.prefix_at(df, marks, "k", "t", "v", 2, parts).collect()}
    assert set(got) == set(edges)
    for k, t in edges:
        for i in range(2):
            assert got[k, t][i] == pytest.approx(sum(v[i] for key, at, v in rows if key == k and at < t))


def test_many_batches_of_one_key(spark):
    """A key whose rows fill several Arrow batches of one partition."""
    df = spark.range(3000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"), F.array(F.lit(1.0)).alias("v"))
    edges = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 2500.5), ("a", 9999.0), ("b", 1.0)], "k string, t double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.k, r.t): r.upto for r in PV.prefix_at(df, edges, "k", "t", "v", 1, 2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {("a", 0.0): [0.0], ("a", 10.0): [10.0], ("a", 2500.5): [2501.0], ("a", 9999.0): [3000.0], ("b", 1.0): [0.0]}


def test_features_of_windows(spark):
    """Equal frames are stable and do not change; opposite ends do not continue each other; an empty window has no timbre."""
    frames = [(1, float(t), [1.0, 2.0, 3.0]) for t in range(8)] + [(2, float(t), [1.0, 2.0, 3.0] if t < 4 else [3.0, 2.0, 1.0]) for t in range(8)]
    df = spark.createDataFrame(frames + [(4, 1.0, [0.0, 0.0, 0.0])], "k long, t double, v array<double>")
    stats = df.select("k", "t", PV.vector_stats(F.col("v")).alias("s"))
    windows = spark.createDataFrame([(1, 0, 0.0, 8.0), (2, 0, 0.0, 8.0), (3, 0, 0.0, 8.0), (4, 0, 0.0, 8.0)], "k long, i int, start double, end double")
    out = PV.window_scores(stats, windows, "k", "t", "s", 3, ["i"], 8.0, full=1.0)
    rows = {r.k: r for r in out.select("k", F.col("continuity").alias("c"), F.col("key_stability").alias("s"), F.col("timbre").alias("t")).collect()}
    assert (rows[1].c, rows[1].s, rows[1].t) == (pytest.approx(1), pytest.approx(1), pytest.approx(0, abs=1e-6))
    assert rows[2].c == pytest.approx(0) and 0 < rows[2].s < 1 and rows[2].t > 0.2
    assert (rows[3].c, rows[3].s, rows[3].t) == (0.5, 0.0, 0.0) and rows[4].s == 0.0


@pytest.mark.parametrize("parts,batch", [(1, 10000), (5, 7), (40, 3)])
def test_windows_cut_by_partitions_and_batches(spark, parts, batch):
    """Every cut gives the sums of a plain loop; frames without a vector only add their value; null is a key."""
    rng = random.Random(parts)
    frames = [(rng.choice([None, 1, 1, 1, 1, 2, 5]), rng.randrange(400) / 8, [rng.random() for _ in range(3)] if rng.random() < 0.8 else None, float(i)) for i in range(300)]
    spans = [(k, i, i * 2.0, i * 2.0 + 8.0) for k in (None, 1, 2, 3) for i in range(24)]
    df = spark.createDataFrame(frames, "k long, t double, v array<float>, x double").repartition(3)
    windows = spark.createDataFrame(spans, "k long, i int, start double, end double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = PV.window_scores(df.select("k", "t", PV.vector_stats(F.col("v"), F.col("x")).alias("s")), windows, "k", "t", "s", 3, ["i"], 8.0, ("x",), full=1.0, parts=parts)
        got = {(r.k, r.i): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(spans)
    for k, i, start, end in spans:
        inside = [(t, v, x) for key, t, v, x in frames if key == k and start <= t < end]
        assert got[k, i].x == pytest.approx(sum(x for _, _, x in inside))
        vectors = [v for _, v, _ in inside if v]
        mean = [sum(v[d] for v in vectors) / max(len(vectors), 1) for d in range(3)]
        size = lambda v: sum(x * x for x in v) ** 0.5
        near = sum(sum(a * b for a, b in zip(mean, v)) / size(v) for v in vectors) / (len(vectors) * size(mean)) if vectors else None
        assert got[k, i].key_stability == pytest.approx(max(0.0, 1 - (1 - near) / 0.4) if vectors else 0.0, abs=1e-5)


def test_frames_move_with_their_own_numbers_only(spark):
    """Squares and unit vectors are made inside the scan, not before the shuffle; floats stay floats."""
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "v array<float>").select(PV.vector_stats(F.col("v"), F.lit(5.0)).alias("s"))
    assert df.schema["s"].dataType.simpleString() == "struct<vec:array<float>,more:array<double>>"
    assert df.first().s == ([1.0, 2.0, 2.0], [5.0])


def test_edges_share_sums():
    """Edges name rows of one matrix: without a frame between them they hold one sum, and no copies of it."""
    ids = pa.table({"_key": [1] * 6, "_i0": [7] * 4 + [8] * 2})
    edges = PV._Edges(ids, np.array([0, 1, 2, 3, 0, 1]), np.array([0, 0, 0, 1, 1, 1]))
    complete, rest = edges.split()
    assert edges.at[complete].tolist() == [[0, 0, 0, 1]] and edges.take(rest).at.tolist() == [1, 1]
    assert (edges + edges.take(rest)).at.tolist() == [0, 0, 0, 1, 1, 1, 1, 1]
