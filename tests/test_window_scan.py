"""Window features by one scan of sorted frames, and as-of lookups by one sort."""
import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import frames as FR
from crestline.operators import ordered as O

SIZES = (4.0, 8.0, 16.0)


def _frames(spark):
    rng = random.Random(3)
    at = {k: sorted(rng.sample(range(n), m)) for k, n, m in ((1, 90, 60), (2, 3, 2), (None, 40, 20), (4, 1, 1), (5, 300, 9))}
    rows = [(k, b, rng.randrange(1, 4), None if rng.random() < 0.1 else rng.random(), rng.random() * 9, rng.random()) for k, bins in at.items() for b in bins]
    return rows, spark.createDataFrame(rows + [(6, None, 1, 1.0, 1.0, 1.0)], "k long, bin long, n long, s1 double, s2 double, peak double").repartition(5)


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_windows_of_frames_in_any_batches(spark, batch):
    """Sums, tops and loud frames as a plain loop over all windows has them; a null value counts for nothing."""
    rows, df = _frames(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = FR.window_features(df, "k", F.array(*[F.lit(s) for s in SIZES]), sums=("peak",)[:0]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r.k, r.size, r["index"]): r for r in found}
    assert len(got) == len(found)
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        duration = max(r[1] for r in mine) + 1.0
        for size in {min(s, duration) for s in SIZES} if duration >= 2 else ():
            for i in range(int((duration - size + 1e-6) // (size / 2)) + 1):
                inside = [r for r in mine if i * size / 2 <= r[1] < i * size / 2 + size]
                if inside:
                    want[k, size, i] = inside
    assert set(got) == set(want)
    for key, inside in want.items():
        r, level = got[key], [(x[4] / x[2]) ** 0.5 for x in inside]
        s1 = [x[3] for x in inside if x[3] is not None]
        assert (r.points, r.frames, r.peak) == (sum(x[2] for x in inside), len(inside), max(x[5] for x in inside))
        assert r.total == (pytest.approx(sum(s1)) if s1 else None) and r.s1_top == max(s1, default=None)
        assert r.energy == pytest.approx(sum(x[4] for x in inside))
        assert r.headroom == pytest.approx(1 - sum(v > 0.4 * max(level) for v in level) / key[1])


def test_frames_are_not_repeated_before_a_sort(spark):
    """A task sorts its frames once, as they are."""
    _, df = _frames(spark)
    plan = FR.window_features(df, "k", F.array(*[F.lit(s) for s in SIZES]))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Sort [") == 1


@pytest.mark.parametrize("parts", [None, 0, 5])
def test_as_of_sorts_left_rows_once(spark, parts):
    """Ties, nulls, and rows before and after all marks."""
    left = [("a", 1.0), ("a", 2.0), ("a", 3.5), ("a", 9.0), ("a", None), ("b", 1.0), (None, 4.0)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k string, t double, id long")
    right = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", 5.0), ("a", None), (None, 4.0), ("c", 1.0)], "k string, at double")
    out = O.as_of(df, right, ["k"], "t", "at", "low", "high", parts=parts)
    assert {r.id: (r.low, r.high) for r in out.collect()} == {
        0: (None, 2.0), 1: (2.0, 2.0), 2: (2.0, 5.0), 3: (5.0, None), 4: (None, 2.0), 5: (None, None), 6: (4.0, 4.0)}
    if parts is None:
        plan = O.as_of(df, right, ["k"], "t", "at", "low", "high", parts=None)._jdf.queryExecution().executedPlan().toString()
        assert "DESC" not in plan
